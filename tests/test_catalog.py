"""Every registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import pytest

from probewise.plans import catalog

duckdb = pytest.importorskip("duckdb")
FOLDER = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def comparable(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def as_rows(rows):
    return sorted((tuple(comparable(v) for v in row) for row in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, oracle, name):
    df = catalog.QUERIES[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    if name not in catalog.SQL:
        assert rows
        return
    cursor = oracle.execute(catalog.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert as_rows(rows) == as_rows([r[i] for i in places] for r in cursor.fetchall())


def test_names():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
    rows = {name.split("_")[0] for name in catalog.QUERIES}
    expected = [("s", 8), ("v", 12), ("p", 10), ("j", 12), ("d", 6), ("a", 13), ("b", 11), ("g", 19), ("e", 7)]
    assert rows == {f"{letter}{i}" for letter, n in expected for i in range(1, n + 1)}
