import numpy as np
import pytest

from probewise.operators import ordered
from probewise.operators.ordered import exact_quantiles, range_cuts, row_numbers, running_sums


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    # group 0 holds a third of the rows and one key value most of them
    data = [
        (i, int(rng.choice([0, 1, 2])), int(rng.choice([5, 5, 5, int(rng.integers(0, 50))])), float(rng.integers(1, 9)))
        for i in range(600)
    ]
    return data, spark.createDataFrame(data, "id long, g int, k int, x double")


@pytest.mark.parametrize("range_rows, listed", [(20, 512), (20, 5), (1000, 512)])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_sums(rows, monkeypatch, range_rows, listed, by):
    monkeypatch.setattr(ordered, "LISTED_RANGES", listed)
    data, df = rows
    order = [("k", False), ("id", True)]
    found = {r["id"]: r["total"] for r in running_sums(df, order, {"x": "total"}, by, range_rows).collect()}
    sums = {}
    for i, g, k, x in sorted(data, key=lambda r: (-r[2], r[0])):
        key = g if by else 0
        sums[key] = sums.get(key, 0) + x
        assert found[i] == sums[key]


def test_ranges_are_even(rows):
    _, df = rows
    order = [("k", True), ("id", True)]
    cuts = range_cuts(df, order, 12, 600)
    assert len(cuts) == 11 and cuts == sorted(cuts)


def test_row_numbers(rows):
    data, df = rows
    found = [r["id"] for r in row_numbers(df, [("id", False)], (), "n", 37).orderBy("n").collect()]
    assert found == [r[0] for r in data][::-1]


@pytest.mark.parametrize("range_rows", [7, 1000])
def test_quantiles(rows, range_rows):
    data, df = rows
    fractions = [0.0, 0.5, 0.95, 0.99, 1.0]
    for r in exact_quantiles(df, "x", fractions, ["g"], "linear", range_rows).collect():
        values = [d[3] for d in data if d[1] == r["g"]]
        assert r["x"] == pytest.approx(np.percentile(values, 100 * r["fraction"]))
    values = sorted(d[2] for d in data)
    for r in exact_quantiles(df, "k", fractions, (), "nearest", range_rows).collect():
        assert r["k"] == values[round((len(values) - 1) * r["fraction"])]


def test_one_and_no_row(spark):
    one = spark.createDataFrame([(3.0,)], "x double")
    assert [r["x"] for r in exact_quantiles(one, "x", [0.5, 0.9]).collect()] == [3.0, 3.0]
    assert exact_quantiles(one.limit(0), "x", [0.5]).count() == 0
    assert row_numbers(one.limit(0), [("x", True)]).count() == 0
