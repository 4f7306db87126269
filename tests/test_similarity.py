import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from probewise.operators import approximate as ann
from probewise.operators import similarity as sim


def unit(m):
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def brute_force(probes, gallery, k):
    found = set()
    for p, v in probes:
        scores = [(-round(float(np.dot(unit(np.array([v]))[0], unit(np.array([g]))[0])), 6), i) for i, g in gallery]
        for rank, (s, i) in enumerate(sorted(scores)[:k], 1):
            found.add((p, i, -s + 0.0, rank))
    return found


def rows_of(df):
    return {(r["probe_id"], r["id"], r["score"], r["rank"]) for r in df.collect()}


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(4, 8))
    # a third of the gallery are copies of one vector, and one vector is zero
    gallery = [(i, (centers[0] if i % 3 == 0 else centers[i % 4] + 0.3 * rng.normal(size=8)).tolist()) for i in range(180)]
    gallery.append((500, [0.0] * 8))
    probes = [(i, (centers[i % 4] + 0.4 * rng.normal(size=8)).tolist()) for i in range(30)]
    g = spark.createDataFrame(gallery, "id long, v array<double>").repartition(3)
    p = spark.createDataFrame(probes, "probe_id long, v array<double>")
    return probes, gallery, p, g


@pytest.mark.parametrize("search", [sim.topk_exact, sim.scan_gallery, sim.scan_probes])
def test_exact_equals_brute_force(tables, search):
    probes, gallery, p, g = tables
    assert rows_of(search(p, g, 7)) == brute_force(probes, gallery, 7)


@pytest.mark.parametrize("block_rows", [16, 50, 10_000])
def test_blocked_equals_brute_force(tables, block_rows):
    probes, gallery, p, g = tables
    assert rows_of(sim.topk_blocked(p, g, 7, block_rows)) == brute_force(probes, gallery, 7)


def test_two_large_sides_take_blocks(tables):
    probes, gallery, p, g = tables
    assert not sim.fits_broadcast(p, 100) and not sim.fits_broadcast(g, 100)
    assert sim.fits_broadcast(p, 8 * 8 * 30) and not sim.fits_broadcast(p, 8 * 8 * 30 - 1)
    # the probes fit, the gallery does not
    assert rows_of(sim.topk_exact(p, g, 3, broadcast_bytes=8 * 8 * 40)) == brute_force(probes, gallery, 3)
    assert rows_of(sim.topk_exact(p, g, 3, broadcast_bytes=100)) == brute_force(probes, gallery, 3)


def test_k_is_clamped_and_empty_sides_give_nothing(spark, tables):
    probes, gallery, p, g = tables
    assert sim.topk_exact(p, g, 1000).count() == len(probes) * len(gallery)
    assert sim.topk_exact(p, g.limit(0), 5).count() == 0
    assert sim.topk_exact(p.limit(0), g, 5).count() == 0
    assert sim.topk_blocked(p, g.limit(0), 5).count() == 0
    assert sim.scan_gallery(p.limit(0), g, 5).count() == 0


def test_text_ids_and_float_vectors(spark):
    g = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("c", [2.0, 0.0, 0.0])], "id string, v array<float>")
    p = spark.createDataFrame([("x", [1.0, 0.0, 0.0])], "probe_id string, v array<float>")
    for found in (sim.scan_probes(p, g, 2), sim.scan_gallery(p, g, 2), sim.topk_blocked(p, g, 2)):
        rows = found.orderBy("rank").collect()
        assert [(r["id"], r["score"], r["distance"]) for r in rows] == [("a", 1.0, 0.0), ("c", 1.0, 0.0)]


@pytest.mark.parametrize("block_rows", [16, 10_000])
def test_all_cells_probed_is_exact(tables, block_rows):
    probes, gallery, p, g = tables
    index = ann.ivf_build(g, 6)
    assert len(index.centroids) <= 6
    assert index.assigned.count() == len(gallery)
    assert rows_of(ann.ivf_search(p, index, 5, nprobe=99, block_rows=block_rows)) == brute_force(probes, gallery, 5)


def test_few_cells_find_most_neighbours_of_clustered_data(tables):
    probes, gallery, p, g = tables
    index = ann.ivf_build(g, 4)
    found = {(a, b) for a, b, _, _ in rows_of(ann.ivf_search(p, index, 5, nprobe=1))}
    wanted = {(a, b) for a, b, _, _ in brute_force(probes, gallery, 5)}
    assert len(found & wanted) / len(wanted) > 0.7


def test_more_cells_than_vectors(spark):
    g = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "id long, v array<double>")
    assert len(ann.ivf_build(g, 50).centroids) <= 3


def test_product_codes(tables):
    probes, gallery, p, g = tables
    books = ann.pq_train(g, parts=4, bits=3)
    assert books.shape == (4, 8, 2)
    codes = ann.pq_encode(g, books)
    assert codes.columns == ["id", "codes"] and {len(r["codes"]) for r in codes.collect()} == {4}
    index = ann.ivf_build(g, 4)
    decoded = {r["id"]: np.concatenate([books[i, c] for i, c in enumerate(r["codes"])]) for r in codes.collect()}
    found = ann.pq_search(p, index, books, 5, nprobe=4).collect()
    vectors = {i: unit(np.array([v]))[0] for i, v in probes}
    for r in found:
        assert r["score"] == pytest.approx(float(vectors[r["probe_id"]] @ decoded[r["id"]]), abs=2e-6)
    # enough candidates, scored again with the stored vectors, are the exact answer
    exact = ann.pq_search(p, index, books, 5, nprobe=4, rescore_from=g.where("id <> 500"), widen=200)
    assert rows_of(exact) == brute_force(probes, gallery[:-1], 5)


def test_impossible_code_shapes(tables):
    *_, g = tables
    with pytest.raises(ValueError):
        ann.pq_train(g, parts=3, bits=2)
    with pytest.raises(ValueError):
        ann.pq_train(g, parts=4, bits=12)
    assert ann.check_code_shape(8, 100, 4, 4, 3) == "100 training vectors, 312 advised"
    assert ann.check_code_shape(8, 1000, 4, 4, 3) == ""


def test_rescore_drops_zero_and_missing(spark, tables):
    *_, p, g = tables
    candidates = spark.createDataFrame([(0, 0, 9.0), (0, 500, 9.0), (0, 12345, 9.0)], "probe_id long, id long, score double")
    rows = sim.rescore(candidates, p, g).collect()
    assert [r["id"] for r in rows] == [0] and -1 <= rows[0]["score"] <= 1


def test_hydrate_keeps_live_rows_only(spark):
    emb = spark.createDataFrame(
        [(1, 1, "c", True), (2, 1, "c", False), (3, 2, "c", True), (4, 1, "o", True), (5, 3, "c", True)],
        "id long, person_id long, pipeline string, is_active boolean",
    )
    people = spark.createDataFrame([(1, "Ann", "active"), (2, "Bob", "deleted"), (3, "x #scale", "active")], "id long, label string, status string")
    candidates = spark.createDataFrame([(7, i, 0.5) for i in (1, 2, 3, 4, 5, 6)], "probe_id long, id long, score double")
    rows = sim.hydrate(candidates, emb, people, "c").collect()
    assert [(r["id"], r["person_id"], r["label"]) for r in rows] == [(1, 1, "Ann")]


def test_score_pairs_statuses(spark):
    pairs = spark.createDataFrame([(1, 1, "a", "b"), (2, 0, "a", "c"), (3, 0, "a", "zz"), (4, 0, "yy", "zz"), (5, 1, "d", "a"), (6, 1, "a", "e")], "pair_id long, label_same int, key1 string, key2 string")
    vectors = spark.createDataFrame(
        [("a", [2.0, 0.0], "ok"), ("b", [4.0, 0.0], "ok"), ("c", [0.0, 3.0], "ok"), ("d", None, "no_face"), ("e", [0.0, 0.0], "ok")],
        "key string, v array<double>, status string",
    )
    rows = {r["pair_id"]: (r["score"], r["status"], r["error"]) for r in sim.score_pairs(pairs, vectors).collect()}
    assert rows == {
        1: (1.0, "ok", ""), 2: (0.0, "ok", ""), 3: (None, "missing_image", "zz"), 4: (None, "missing_image", "yy; zz"),
        5: (None, "no_face", "no_face"), 6: (None, "error", "error"),
    }


def test_widening(spark):
    scores = {1: 0.9, 2: 0.42, 3: 0.1}
    probes = spark.createDataFrame([(i, [1.0]) for i in (1, 2, 3, 4)], "probe_id long, v array<double>")
    wide_calls = []

    def search(wanted, k, nprobe):
        wide_calls.append((k, nprobe))
        hits = spark.createDataFrame([(p, 10 * p, s) for p, s in scores.items()], "probe_id long, id long, score double")
        if k > 5:
            more = spark.createDataFrame([(4, 40, 0.2), (3, 31, 0.05)], "probe_id long, id long, score double")
            hits = hits.where("probe_id <> 3").unionByName(more)
        return wanted.select("probe_id").join(hits, "probe_id")

    found, info = ann.search_dynamic(probes, search, 2, 0.4, k_fast=5, k_safe=9)
    rows = {r["probe_id"]: tuple(r)[1:] for r in info.collect()}
    assert rows == {
        1: (0.9, "fast", 5, None),
        2: (0.42, "safe_fallback", 9, "near_threshold"),
        3: (0.1, "fast", 5, None),
        4: (0.2, "safe_fallback", 9, "no_candidates"),
    }
    assert {(r["probe_id"], r["id"]) for r in found.collect()} == {(1, 10), (2, 20), (3, 30), (4, 40)}
    assert wide_calls == [(5, 32), (9, 128)]
    _, live = ann.search_dynamic(probes, search, 2, 0.4, mode="live", k_fast=5)
    assert {(r["search_mode"], r["candidate_k"], r["fallback_reason"]) for r in live.collect()} == {("live_fast", 5, None)}


def test_profile_of_one_probe(spark):
    gallery = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [1.0, 1.0])], "identity string, v array<double>")
    probe = spark.createDataFrame([([1.0, 0.0],)], "v array<double>")
    rows = {r["identity"]: r for r in sim.similarity_profile(probe, gallery).collect()}
    assert (rows["a"]["avg_score"], rows["a"]["max_score"], rows["a"]["min_score"], rows["a"]["is_best"]) == (0.5, 1.0, 0.0, False)
    assert rows["b"]["is_best"]


def test_centroid_accuracy(spark):
    rows = [(0, "a", [1.0, 0.1]), (1, "a", [1.0, -0.1]), (2, "b", [0.0, 1.0]), (3, "b", [0.9, 0.2])]
    df = spark.createDataFrame(rows, "id long, label string, v array<double>")
    row = sim.centroid_accuracy(df, "label", "v", "id").first()
    assert (row["items"], row["correct"], row["accuracy"]) == (4, 3, 0.75)


@pytest.mark.parametrize("path", ["probes", "gallery", "blocked", "exact"])
def test_broken_vectors_and_repeated_probes(spark, path):
    """A vector that can't be compared takes no place, and all paths agree."""
    nan = float("nan")
    vectors = [(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [nan, 1.0]), (4, [1.0]), (5, [1.0, 0.0, 9.0]), (6, None), (7, [0.0, 1.0]), (8, [0.0, 0.0])]
    gallery = spark.createDataFrame(vectors, "id long, v array<double>")
    probes = spark.createDataFrame([(10, [1.0, 0.0]), (10, [1.0, 0.0]), (11, [nan, 0.0]), (12, [1.0, 2.0, 3.0]), (13, [0.0, 2.0])], "probe_id long, v array<double>")
    sides = sim.usable_sides(probes, gallery)
    found = {
        "probes": lambda: sim.scan_probes(*sides, 2),
        "gallery": lambda: sim.scan_gallery(*sides, 2),
        "blocked": lambda: sim.topk_blocked(probes, gallery, 2, 2),
        "exact": lambda: sim.topk_exact(probes, gallery, 2),
    }[path]()
    assert sorted((r["probe_id"], r["id"], r["score"], r["rank"]) for r in found.collect()) == [(10, 1, 1.0, 1), (10, 2, 0.8, 2), (13, 2, 0.6, 2), (13, 7, 1.0, 1)]
    assert tuple(sim.left_out(gallery, 2).first()) == (8, 1, 2, 1)


@pytest.mark.parametrize("n", [1, 3, 9])
def test_best_cells_do_not_depend_on_blocks(n):
    # whole numbers, so that products are exact and ties are many
    rng = np.random.default_rng(3)
    vectors, centroids = rng.integers(-2, 3, (40, 3)).astype(float), rng.integers(-2, 3, (9, 3)).astype(float)
    whole = np.argsort(-(vectors @ centroids.T), axis=1, kind="stable")[:, :n]
    for block in (1, 2, 4, 100):
        assert (ann.best_cells(vectors, centroids, n, block) == whole).all()


def test_small_blocks_are_not_shipped_to_each_other(spark):
    def rows(key):
        number = F.col("id")
        return spark.range(3000).select(number.alias(key), F.array(F.rand(1), F.rand(2)).alias("v"), (number % 2).cast("int").alias("cell"))

    # what a pair of blocks gets, as (probe id, id, score)
    sizes = sim.blocked_scores(
        rows("probe_id"), rows("id"), 3, 16, 2, lambda left, right: ([len(left)], [len(right)], [0.0])
    ).collect()
    assert sum(r["probe_id"] * r["id"] for r in sizes) == 2 * 1500 * 1500
    assert sum(r["probe_id"] + r["id"] for r in sizes) <= (1 + sim.PROBE_BLOCKS) * 3000
    assert len(sizes) == 2 * sim.PROBE_BLOCKS


@pytest.mark.parametrize("order", ["rising", "falling", "equal"])
def test_the_floor_of_a_slice_holds_for_the_next(order):
    rng, count = np.random.default_rng(2), 3 * sim.SLICE_ROWS + 5
    vectors = sim.unit_rows(rng.normal(size=(count, 4)))
    probes = sim.unit_rows(np.vstack([vectors[:1], rng.normal(size=(4, 4))]))
    vectors = vectors[np.argsort(vectors @ probes[0])] if order != "equal" else np.repeat(vectors[:1], count, axis=0)
    vectors, ids = (vectors[::-1] if order == "falling" else vectors), rng.permutation(count)
    whole = np.round(probes @ vectors.T, 6)
    for k, floor in ((1, None), (7, None), (7, np.sort(whole, axis=1)[:, -7])):
        rows, found, scores = sim.score_block(np.arange(5), probes, ids, vectors, k, floor)
        for i in range(5):
            best = np.lexsort((ids, -whole[i]))[:k]
            assert list(found[rows == i]) == list(ids[best])
            assert np.abs(scores[rows == i] - whole[i][best]).max() < 2e-6


def test_a_block_gathers_few_places_at_a_time(monkeypatch):
    rng = np.random.default_rng(4)
    vectors = lambda n: pa.array(rng.normal(size=(n, 8)).tolist())
    asked = pa.array([list(range(5))] * 300, pa.list_(pa.int32()))
    left = pa.table({"probe_id": np.arange(300), "v": vectors(300), "floor": pa.nulls(300, pa.float64()), "inner": asked})
    right = pa.table({"id": np.arange(400), "v": vectors(400), "inner": (np.arange(400) % 5).astype(np.int32)})
    whole = sorted(zip(*sim.score_cells(left, right, 7)))
    sizes, first = [], sim.first_k
    monkeypatch.setattr(sim, "PLACES", 140, raising=False)
    monkeypatch.setattr(sim, "first_k", lambda row, *rest: (sizes.append(len(row)), first(row, *rest))[1])
    # a cell's share of each of the twenty probes, five cells at most
    assert sorted(zip(*sim.score_cells(left, right, 7))) == whole and max(sizes) <= 5 * 140


@pytest.mark.parametrize("n", [1, 6])
def test_vectors_are_repeated_for_their_cells_some_at_a_time(spark, monkeypatch, n):
    rng = np.random.default_rng(6)
    rows, centroids = rng.normal(size=(9000, 4)), unit(rng.normal(size=(9, 4)))
    df = spark.createDataFrame([(0, [0.0])], "id long, v array<double>")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, function, schema: function)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(9000)), pa.array(rows.tolist())], names=["id", "v"])
    parts = list(ann.nearest_cells(df, "id", centroids, n)([batch]))
    assert max(part.num_rows for part in parts) <= sim.SLICE_ROWS
    found = pa.Table.from_batches(parts)
    assert found["id"].to_pylist() == np.repeat(np.arange(9000), n).tolist()
    assert found["cell"].to_pylist() == ann.best_cells(rows, centroids, n).ravel().tolist()


# held probes


def held_table(probes, cells, floor=None):
    lists = lambda kind, x: pa.array([[x(c) for c in own] for own in cells], pa.list_(kind))
    return pa.table({
        "probe_id": np.arange(len(probes)) * 2,
        "v": pa.array(probes.tolist()),
        "inner": lists(pa.int32(), int),
        "base": lists(pa.float64(), lambda _: 0.0),
        "floor": pa.array([None] * len(probes) if floor is None else floor, pa.float64()),
    })


@pytest.mark.parametrize("once", [False, True])
def test_held_probes_keep_the_best_of_all_that_pass(once):
    rng = np.random.default_rng(8)
    probes, vectors = rng.normal(size=(700, 3)), sim.unit_rows(rng.integers(-2, 3, (9000, 3)).astype(float))
    # equal scores are many, and ids repeat where they count once
    cells, tags = rng.integers(0, 3, 9000), rng.integers(0, 2, 9000)
    ids = rng.permutation(9000) % (4000 if once else 9000)
    asked = [sorted(rng.choice(3, rng.integers(1, 4), replace=False)) for _ in range(700)]
    state = sim.HeldProbes(held_table(probes, asked), 6, 2, once)
    for cell in range(3):
        for low in range(0, 9000, 5000):
            for tag in (1, 0):
                at = np.flatnonzero((cells == cell) & (tags == tag) & (np.arange(9000) // 5000 == low // 5000))
                state.meet(cell, tag, ids[at], sim.VectorRows(vectors[at]))
        assert max(len(part[0]) for part in state.best) <= 6 * 700
    found = [np.concatenate(column) for column in zip(*state.result())]
    whole = np.round(sim.unit_rows(probes) @ vectors.T, 6) + 0.0
    for i in range(0, 700, 23):
        for most in range(2):
            def best(some_ids, scores):
                if once:
                    some_ids, at = np.unique(some_ids, return_inverse=True)
                    top = np.full(len(some_ids), -9.0)
                    np.maximum.at(top, at, scores)
                    scores = top
                order = np.lexsort((some_ids, -scores))[:6]
                return list(zip(some_ids[order], np.round(scores[order], 5)))

            reach = np.isin(cells, asked[i]) & (tags <= most)
            own = (found[0] == 2 * i) & (found[3] <= most)
            assert best(found[1][own], found[2][own]) == best(ids[reach], whole[i][reach])


def test_the_order_of_scores_is_that_of_three_keys():
    rng = np.random.default_rng(9)
    row, ids, scores = rng.integers(0, 50, 5000), rng.integers(0, 900, 5000), np.round(rng.integers(-9, 9, 5000) / 7, 6)
    for a, b in ((row, ids), (row + (1 << 22), ids), (row, ids.astype(str).astype(object))):
        wanted = np.lexsort((b, -scores, a))
        order = sim.score_order(a, b, scores)
        assert (a[order] == a[wanted]).all() and (b[order] == b[wanted]).all() and (scores[order] == scores[wanted]).all()


def test_tasks_of_held_probes():
    asked, held = {0: 100_000, 1: 10, 2: 5, 7: 9}, {0: 50_000, 1: 4_000_000, 2: 8, 9: 3}
    plan = sim.plan_tasks(asked, held, 1000, 32_768, 16_384, 264, 4)
    cells = {cell: rest for cell, *rest in plan.cells}
    assert set(cells) == {0, 1, 2}
    # blocks of probes for the first, streams of pages for the second, which are too many bytes for one
    assert cells[0][:2] == [100, 1] and cells[1][:2] == [1, 4] and cells[2][:2] == [1, 1]
    numbers = [n for _, _, own, _ in cells.values() for n in own]
    assert numbers == list(range(105)) and max(p for *_, parts in cells.values() for p in parts) == plan.partitions - 1
    # few tasks share the rows of a large cell
    few = sim.plan_tasks({0: 10}, {0: 400_000}, 1000, 32_768, 16_384, 264, 4).cells[0]
    assert few[1:3] == (1, 8)


def test_rescoring_in_passing_equals_the_join(spark, tables):
    probes, gallery, p, g = tables
    odd = spark.createDataFrame([(900, [0.0] * 8), (901, None), (902, [1.0])], "id long, v array<double>")
    stored = g.unionByName(odd.select(*g.columns))
    near = sim.topk_exact(p, g, 9).select("probe_id", "id", "score")
    near = near.unionByName(p.select("probe_id", F.explode(F.array(*[F.lit(i).cast("long") for i in (900, 901, 902, 999)])).alias("id"), F.lit(0.0).alias("score")))
    wanted = sim.keep_best(sim.rescore(near, p, stored).select("probe_id", "id", "score"), 5)
    width = sim.usual_width(g)
    assert rows_of(sim.keep_best(sim.rescore_passing(near, p, stored, 5, width, block_rows=16), 5)) == rows_of(wanted)
