"""The benchmark over sizes, and k-fold targets and overall metrics, against plain computations."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from probewise.operators import approximate as ann
from probewise.operators import benchmark as bench
from probewise.operators import verification as ver


def place(i):
    return int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2**32


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(12)
    gallery = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    probes = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(30)]
    return (
        spark.createDataFrame(probes, "probe_id long, v array<double>").cache(),
        spark.createDataFrame(gallery, "id long, v array<double>").cache(),
    )


def rows_of(df):
    return {(r["probe_id"], r["id"], r["score"], r["rank"]) for r in df.collect()}


def test_one_search_serves_all_sizes(sides):
    p, g = sides
    shares = (0.2, 0.7)
    index = ann.ivf_assign(g, np.array([r["v"] for r in g.limit(6).collect()]))
    for method in (bench.flat_method(g), bench.Method("ivf", "ivf", ann.CellSearch(index), 2)):
        found = bench.sized_search(method, p, 5, shares).cache()
        work = {(r["share"], r["probe_id"]): r["scanned"] for r in bench.scanned_rows(method, p, shares).collect()}
        for share in shares:
            small = g.where(F.col("id").isin([i for i in range(400) if place(i) < share]))
            alone = ann.CellIndex(method.search.index.centroids, method.search.rows.join(small.select("id"), "id", "left_semi"))
            assert rows_of(found.where(F.col("share") == share)) == rows_of(ann.ivf_search(p, alone, 5, method.nprobe))
            counts = ann.probed_cells(p, alone, method.nprobe).join(alone.assigned.select("id", "cell"), "cell").groupBy("probe_id").count()
            assert {r["probe_id"]: r["count"] for r in counts.collect()} == {i: n for (s, i), n in work.items() if s == share and n}


def test_a_size_takes_no_copies_of_the_probes(sides):
    """The rows of all sizes come from one pass of the gallery: ``k`` rows a probe and tag, none for each cell."""
    p, g = sides
    shares = (0.2, 0.7)
    index = ann.ivf_assign(g, np.array([r["v"] for r in g.limit(6).collect()]))
    local = ann.CellSearch(index).scores(p, 5, 0, 6, 3, bench.tag_of("id", shares))
    counts = {r["tag"]: r["count"] for r in local.groupBy("tag").count().collect()}
    assert set(counts) <= {0, 1, 2} and max(counts.values()) <= 5 * 30
    whole = bench.sized_search(bench.flat_method(g), p, 5, shares)
    assert rows_of(bench.sized_search(bench.Method("ivf", "ivf", ann.CellSearch(index), 6), p, 5, shares)) == rows_of(whole)


def test_failed_methods_stay(sides):
    p, g = sides
    index = ann.ivf_build(g, 4)
    methods = [
        bench.attempt("pq_3", "ivfpq", lambda: ann.CellSearch(ann.code_index(index, ann.code_train(index, 3, 2))), 4),
        bench.attempt("pq_4", "ivfpq", lambda: ann.CellSearch(ann.code_index(index, ann.code_train(index, 4, 3))), 4, {"m": 4, "nbits": 3}, "thin"),
    ]
    rows, seconds = bench.benchmark_sizes(p, g, methods, (0.5, 1.0), (1, 5))
    found = {(r["share"], r["method"]): r for r in rows.collect()}
    assert len(found) == 4 and set(seconds) == {"pq_4"}
    failed, good = found[1.0, "pq_3"], found[1.0, "pq_4"]
    assert (failed["status"], failed["overlap_at_5"], failed["memory_bytes"]) == ("failed", None, None) and "3 equal parts" in failed["error"]
    assert (good["status"], good["notes"], good["memory_bytes"], good["vectors"]) == ("ok", "thin", 600, 400)
    assert good["scanned_mean"] == 400 and 0 < good["overlap_at_5"] <= 1
    only = bench.benchmark_sizes(p, g, methods[:1], (1.0,), (1,))[0].collect()
    assert [(r["status"], r["scanned_p50"], r["overlap_at_1"]) for r in only] == [("failed", None, None)]


GRID = (np.arange(ver.GRID_STEPS + 1) - ver.GRID_STEPS // 2) / (ver.GRID_STEPS / 2)


def rates(scores, labels):
    above = scores[None, :] >= GRID[:, None]
    same = labels == 1
    return above[:, ~same].mean(axis=1), above[:, same].mean(axis=1)


def test_kfold_targets_and_overall(spark):
    rng = np.random.default_rng(7)
    n = 400
    labels = rng.integers(0, 2, n)
    scores = np.round(np.clip(rng.normal(0.1 + 0.4 * labels, 0.2), -1, 1), 6)
    ok = rng.random(n) < 0.9
    pairs = spark.createDataFrame(
        [(i + 1, float(s), "ok" if good else "no_face", int(y)) for i, (s, good, y) in enumerate(zip(scores, ok, labels))],
        "pair_id long, score double, status string, label int",
    )
    folds = np.minimum(np.arange(n) // (n // 5), 4)
    found = {(r["fold"], r["target_far"]): r for r in ver.kfold_targets(pairs, 5).collect()}
    assert len(found) == 5 * len(ver.FOLD_TARGET_FARS)
    for (fold, target), r in found.items():
        train, test = ok & (folds != fold - 1), ok & (folds == fold - 1)
        far, tar = rates(scores[train], labels[train])
        usable = np.flatnonzero(far <= target)
        best = usable[np.argmax(tar[usable])]
        test_far, test_tar = rates(scores[test], labels[test])
        wanted = (GRID[best], far[best], 1 - tar[best], test_tar[best], test_far[best])
        assert tuple(r[c] for c in ("threshold", "train_far", "train_frr", "test_tar", "test_far")) == pytest.approx(wanted)

    overall = {r["metric"]: r for r in ver.kfold_overall(pairs, 5).collect()}
    far, tar = rates(scores[ok], labels[ok])
    p, q = (labels[ok] == 1).sum(), (labels[ok] == 0).sum()
    accuracy = (tar * p + (1 - far) * q) / (p + q)
    assert overall["accuracy"]["value"] == pytest.approx(accuracy.max())
    assert overall["accuracy"]["threshold"] == pytest.approx(GRID[np.argmax(np.round(accuracy, 12))])
    gap = far - (1 - tar)
    assert far[gap < 0].max() <= overall["eer"]["value"] + 0.05 and overall["eer"]["far"] == pytest.approx(overall["eer"]["frr"])
    assert overall["tar_at_far_0_1"]["value"] == pytest.approx(tar[far <= 0.1].max())


def test_kfold_overall_of_one_class(spark):
    pairs = spark.createDataFrame([(i + 1, i / 10, "ok", 1) for i in range(9)], "pair_id long, score double, status string, label int")
    overall = {r["metric"]: r for r in ver.kfold_overall(pairs, 3).collect()}
    assert overall["eer"]["value"] is None and overall["tar_at_far_0_1"]["value"] is None and overall["accuracy"]["value"] == 1.0
    targets = ver.kfold_targets(pairs, 3).collect()
    assert {(r["threshold"], r["train_far"], r["test_tar"]) for r in targets} == {(None, None, 0.0)}
