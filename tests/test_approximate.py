"""Cells, stored residual codes, incremental widening and bounded exact search against brute force."""

import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from probewise.operators import approximate as ann
from probewise.operators import similarity as sim
from probewise.plans.flows import read_codes, write_codes

DIM = 16


def clustered(seed, n, centres=20, spread=0.35):
    rng = np.random.default_rng(seed)
    points = np.random.default_rng(99).normal(size=(centres, DIM))
    v = points[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, DIM))
    return [(i, [float(x) for x in row]) for i, row in enumerate(v)]


@pytest.fixture(scope="module")
def sides(spark):
    probes, gallery = clustered(1, 120), clustered(2, 1500)
    g = spark.createDataFrame(gallery, "id long, v array<double>").repartition(4).cache()
    p = spark.createDataFrame(probes, "probe_id long, v array<double>").cache()
    return probes, gallery, p, g


def brute_force(probes, gallery, k):
    ids = np.array([i for i, _ in gallery])
    scores = np.round(sim.unit_rows(np.array([v for _, v in probes])) @ sim.unit_rows(np.array([v for _, v in gallery])).T, 6) + 0.0
    return {
        (probe, int(ids[j]), float(row[j]), rank)
        for (probe, _), row in zip(probes, scores)
        for rank, j in enumerate(np.lexsort((ids, -row))[:k], 1)
    }


def rows_of(df):
    return {(r["probe_id"], r["id"], r["score"], r["rank"]) for r in df.collect()}


def recall(found, wanted):
    return len({x[:2] for x in found} & {x[:2] for x in wanted}) / len(wanted)


# bounded exact search


@pytest.mark.parametrize(("block_rows", "routes"), [(50, 1024), (7, 20), (5000, 3)])
def test_bounded_search_is_exact(sides, block_rows, routes):
    probes, gallery, p, g = sides
    assert rows_of(sim.topk_bounded(p, g, 7, block_rows, routes)) == brute_force(probes, gallery, 7)


def test_bounded_search_skips_blocks(sides):
    *_, p, g = sides
    report = sim.block_report(p, g, 5, block_rows=50).first()
    assert report["probes"] == 120 and report["pairs"] == 120 * report["cells"] and report["skipped"] > 0.5


def test_a_probe_is_shipped_once_to_a_bundle_of_cells(sides):
    probes, gallery, p, g = sides
    blocks = sim.route_blocks(g, 7)
    cells = int((blocks.counts > 0).sum())
    bundles = blocks.bundles(len(gallery) // 3)
    assert cells > 10 and len(bundles) == len(blocks.counts) and 2 <= bundles.max() <= 6
    far = sim.visits(p.select("probe_id", "v", F.lit(None).cast("double").alias("floor")), blocks, bundles, False).collect()
    assert len(far) <= len(probes) * (bundles.max() + 1)
    assert sum(len(r["inner"]) for r in far) == len(probes) * (cells - 1)
    assert all(bundles[cell] == r["cell"] for r in far for cell in r["inner"])


def test_bounded_search_counts_an_id_once(sides):
    probes, gallery, p, g = sides
    twice = g.unionByName(g).unionByName(g.select("id", F.transform("v", lambda x: x * 0.5).alias("v")))
    assert rows_of(sim.topk_bounded(p, twice, 7, 7)) == brute_force(probes, gallery, 7)


def test_bounded_search_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    gallery = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    gallery += [(100 + i, [0.0] * 4) for i in range(9)] + [(200 + i, gallery[0][1]) for i in range(30)]
    probes = [(0, gallery[0][1]), (1, [0.0] * 4), (2, [-x for x in gallery[0][1]]), (3, [1e-9, 0.0, 0.0, 0.0])]
    odd = [(300, [1.0]), (301, None), (302, [float("nan")] * 4), (303, [1.0, None, 0.0, 0.0])]
    g = spark.createDataFrame(gallery + odd, "id long, v array<double>")
    p = spark.createDataFrame(probes + [(9, [1.0])], "probe_id long, v array<double>")
    for k in (3, 500):
        wanted = brute_force(probes, gallery, k)
        assert rows_of(sim.topk_bounded(p, g, k, 8)) == wanted
        # the path that two large sides take
        assert rows_of(sim.topk_exact(p, g, k, broadcast_bytes=0)) == wanted
    assert sim.topk_bounded(p, g.limit(0), 3).collect() == []
    assert sim.topk_bounded(p.limit(0), g, 3).collect() == []
    assert rows_of(sim.topk_bounded(p, g.where("id >= 100 AND id < 109"), 2)) == brute_force(probes, gallery[60:69], 2)


# cells


def test_broken_vectors_are_left_out_of_cells(spark):
    good = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8]), (4, [0.0, 0.0])]
    bad = [(5, [1.0, 2.0, 3.0]), (6, [1.0]), (7, None), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (10, [None, 1.0])]
    g = spark.createDataFrame(good + bad, "id long, v array<double>")
    asked = [(1, [1.0, 0.1])]
    p = spark.createDataFrame(asked + [(2, [1.0] * 3), (3, None), (4, [float("nan")] * 2)], "probe_id long, v array<double>")
    for index in (ann.ivf_build(g, 2), ann.ivf_assign(g, np.eye(2))):
        assert sorted(r["id"] for r in index.assigned.collect()) == [1, 2, 3, 4]
        assert rows_of(ann.ivf_search(p, index, 9, nprobe=2)) == brute_force(asked, good, 9)
        books = np.zeros((2, 2, 1))
        assert {r["probe_id"] for r in ann.pq_search(p, index, books, 9, nprobe=2).collect()} == {1}
    assert sim.left_out(g, 2).first().asDict() == {"rows": 10, "missing": 1, "other_width": 2, "not_finite": 3}


def test_many_centroids_are_searched_in_blocks(spark, sides):
    probes, _, p, _ = sides
    centroids = sim.unit_rows(np.random.default_rng(5).normal(size=(40, DIM)))
    repeated = p.unionByName(p.limit(3))

    def rows(df):
        return sorted((r["probe_id"], r["cell"], round(r["base"], 9)) for r in df.collect())

    for n, first in ((1, 0), (5, 0), (9, 4)):
        held = rows(ann.nearest_cells(repeated, "probe_id", centroids, n, first))
        assert rows(ann.nearest_cells(repeated, "probe_id", centroids, n, first, limit=0)) == held
        assert len(held) == (len(probes) + 3) * (n - first)


def test_training_reads_a_bounded_sample(sides):
    *_, g = sides
    assert 100 < ann.training_sample(g, 300, ann.SEED).count() < 600
    index = ann.ivf_build(g, 8, train_rows=300)
    assert index.assigned.count() == 1500 and len(index.centroids) == 8


def test_recall_of_cells(sides):
    probes, gallery, p, g = sides
    index = ann.ivf_build(g, 12)
    wanted = brute_force(probes, gallery, 10)
    found = [recall(rows_of(ann.ivf_search(p, index, 10, n)), wanted) for n in (1, 4, 12)]
    assert found[0] <= found[1] <= found[2] == 1.0 and found[1] >= 0.9


# stored codes


def test_stored_codes_have_no_vectors(spark, sides, tmp_path):
    probes, gallery, p, g = sides
    index = ann.ivf_build(g, 6)
    books = ann.code_train(index, parts=8, bits=5)
    assert books.shape == (8, 32, 2)
    path = str(tmp_path / "codes")
    write_codes(ann.code_index(index, books), path)
    again = read_codes(spark, path)
    assert sorted(again.coded.columns) == ["cell", "codes", "id"] and again.residual
    assert np.array_equal(again.books, books) and np.array_equal(again.centroids, index.centroids)
    # a byte for each part, in a folder per cell
    files = glob.glob(f"{path}/codes/cell=*/*.parquet")
    stored = [row for f in files for row in pq.read_table(f).to_pylist()]
    assert len(stored) == 1500 and {len(r["codes"]) for r in stored} == {8}

    # scores are products with the centroid and the parts that the codes name
    rows = {r["id"]: (r["cell"], np.frombuffer(bytes(r["codes"]), np.uint8)) for r in again.coded.collect()}
    vectors = {i: u for (i, _), u in zip(probes, sim.unit_rows(np.array([v for _, v in probes])))}
    found = ann.code_search(p, again, 10, nprobe=6, block_rows=100).collect()
    assert len(found) == 1200
    for r in found:
        cell, codes = rows[r["id"]]
        whole = index.centroids[cell] + np.concatenate([books[i, c] for i, c in enumerate(codes)])
        assert r["score"] == pytest.approx(float(vectors[r["probe_id"]] @ whole), abs=2e-6)

    # residuals are coded more finely than the vectors; the stored vectors settle the rest
    wanted = brute_force(probes, gallery, 10)
    plain = ann.pq_search(p, index, ann.pq_train(g, 8, 5), 10, nprobe=6)
    coded = recall({(r["probe_id"], r["id"]) for r in found}, wanted)
    assert coded > recall(rows_of(plain), wanted) - 0.02
    assert recall(rows_of(ann.code_search(p, again, 10, nprobe=6, rescore_from=g)), wanted) >= 0.9
    assert rows_of(ann.code_search(p, again, 5, nprobe=6, rescore_from=g, widen=300)) == brute_force(probes, gallery, 5)


def test_codes_are_made_once_and_read_alone(sides):
    *_, p, g = sides
    index = ann.ivf_build(g, 6)
    codes = ann.code_index(index, ann.code_train(index, parts=4, bits=4))
    plan = ann.rows_of_cells(codes.coded, ann.probed_cells(p, codes, 2))._jdf.queryExecution().executedPlan().toString()
    assert "codes" in plan and "array" not in plan and "mapInArrow" not in plan


def test_code_shapes(spark, sides):
    *_, g = sides
    index = ann.ivf_build(g, 4)
    with pytest.raises(ValueError):
        ann.code_train(index, parts=5, bits=4)
    with pytest.raises(ValueError):
        ann.code_train(index, parts=4, bits=11)
    with pytest.raises(ValueError):
        ann.code_index(index, np.zeros((4, 512, 4)))


def test_tables_of_products_agree_with_decoded_rows():
    rng = np.random.default_rng(11)
    books, codes = rng.normal(size=(3, 7, 2)), rng.integers(0, 7, size=(9000, 3)).astype(np.uint8)
    probes, base, ids = rng.normal(size=(600, 6)), rng.normal(size=600), rng.permutation(9000)
    keys, found, scores = ann.score_codes(np.arange(600) * 2, probes, base, ids, codes, books, 4)
    whole = np.round(probes @ books[np.arange(3), codes].reshape(9000, 6).T + base[:, None], 6)
    for i in range(0, 600, 37):
        order = np.lexsort((ids, -whole[i]))[:4]
        own = keys == 2 * i
        assert set(zip(found[own], np.round(scores[own], 6))) == set(zip(ids[order], whole[i][order]))


# widening


@pytest.mark.parametrize("coded", [False, True])
def test_widening_goes_on_with_the_next_cells(spark, sides, coded):
    *_, p, g = sides
    index = ann.ivf_build(g, 10)
    if coded:
        index = ann.code_index(index, ann.code_train(index, parts=8, bits=4))
    search = ann.CellSearch(index)
    kept = search(p, 30, 2)
    assert rows_of(search.widen(p, kept, 30, 2, 7)) == rows_of(search(p, 30, 7))
    assert rows_of(search.widen(p, kept, 30, 2, 2)) == rows_of(kept)
    assert rows_of(search.widen(p, search(p, 9, 50), 9, 50, 90)) == rows_of(search(p, 9, 10))
    # the second pass scores none of the cells of the first one
    first = {(r["probe_id"], r["cell"]) for r in ann.probed_cells(p, index, 2).collect()}
    later = {(r["probe_id"], r["cell"]) for r in ann.probed_cells(p, index, 7, 2).collect()}
    assert not first & later and len(first | later) == 7 * 120


def test_two_passes_equal_two_searches(sides):
    *_, p, g = sides
    # cells that cut through the clusters, so the best row can be in another one
    index = ann.ivf_assign(g, np.random.default_rng(5).normal(size=(10, DIM)))
    widths = {"k_fast": 4, "k_safe": 12, "nprobe_fast": 1, "nprobe_safe": 6}
    cells = ann.CellSearch(index)
    found, info = ann.search_dynamic(p, cells, 3, 0.91, **widths)
    same, told = ann.search_dynamic(p, lambda probes, k, n: ann.ivf_search(probes, index, k, n), 3, 0.91, **widths)
    assert rows_of(found) == rows_of(same)
    assert sorted(info.collect()) == sorted(told.collect())
    assert {r["search_mode"] for r in info.collect()} == {"fast", "safe_fallback"}
    fast = {r["probe_id"]: r["score"] for r in cells(p, 1, 1).collect()}
    assert any(r["best_score"] > fast[r["probe_id"]] for r in info.collect())


# held probes


@pytest.mark.parametrize("coded", [False, True])
@pytest.mark.parametrize("nprobe", [1, 7])
def test_a_search_of_cells_gives_back_the_best_rows_once(sides, coded, nprobe):
    """Not the best of each cell: ``k`` rows a probe, whatever the number of cells that it asks for."""
    probes, _, p, g = sides
    index = ann.ivf_build(g, 10)
    if coded:
        index = ann.code_index(index, ann.code_train(index, parts=8, bits=4))
    search = ann.CellSearch(index, 40)
    local = search.scores(p, 4, 0, nprobe).drop("tag")
    assert local.count() <= 4 * len(probes)
    each = search.block_scores(ann.probed_cells(p, index, nprobe), search.rows, 4)
    assert rows_of(sim.keep_best(local, 4)) == rows_of(sim.keep_best(each, 4))


def test_the_cells_of_a_probe_are_written_as_one_row(sides):
    probes, _, p, g = sides
    index = ann.ivf_build(g, 10)
    assert ann.probed_lists(p, index, 7).count() == len(probes)
    assert ann.probed_cells(p, index, 7).count() == 7 * len(probes)


def test_searches_with_text_ids_and_repeated_probes(spark, sides):
    *_, p, g = sides
    named = g.select(F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("id"), "v")
    index = ann.ivf_assign(g, np.random.default_rng(5).normal(size=(10, DIM)))
    same = ann.CellIndex(index.centroids, index.assigned.join(g.select("id"), "id").withColumn("id", F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 6, "0"))))

    def numbered(df):
        return {(a, int(b[1:]), c, d) for a, b, c, d in rows_of(df)}

    twice = p.unionByName(p)
    assert numbered(ann.ivf_search(twice, same, 5, 4)) == rows_of(ann.ivf_search(p, index, 5, 4))
    assert numbered(sim.topk_bounded(twice, named, 5, 50)) == rows_of(sim.topk_exact(p, g, 5))


def test_ids_that_repeat_take_the_places_of_their_cells(sides):
    """As before: every cell gives its best, so copies in one leave places for the others."""
    *_, p, g = sides
    index = ann.ivf_build(g, 6)
    twice = ann.CellIndex(index.centroids, index.assigned.unionByName(index.assigned))
    wanted = sim.keep_best(sim.blocked_scores(ann.probed_cells(p, twice, 4).drop("base"), twice.assigned, 6, 16_384, DIM), 6)
    assert ann.repeated(twice.assigned) and not ann.repeated(index.assigned)
    assert rows_of(ann.ivf_search(p, twice, 6, 4)) == rows_of(wanted)


def test_many_candidates_are_rescored_in_passing(sides, monkeypatch):
    *_, p, g = sides
    index = ann.ivf_build(g, 6)
    codes = ann.code_index(index, ann.code_train(index, parts=8, bits=4))
    joined = ann.code_search(p, codes, 5, 6, rescore_from=g)
    monkeypatch.setattr(ann, "JOINED_CANDIDATES", 0)
    monkeypatch.setattr(ann, "rescore", None)
    assert rows_of(ann.code_search(p, codes, 5, 6, rescore_from=g)) == rows_of(joined)
