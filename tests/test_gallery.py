from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from probewise.operators import gallery as gal

START = datetime(2024, 1, 1)
SUBJECT = "id string, label string, status string, created_at timestamp, updated_at timestamp"
EMBEDDING = "id string, person_id string, pipeline string, model string, dim int, vector binary, created_at timestamp, is_active boolean"


def subjects(spark, rows):
    return spark.createDataFrame([(i, l, s, START + timedelta(minutes=m), START) for i, l, s, m in rows], SUBJECT)


def embeddings(spark, rows):
    return spark.createDataFrame([(i, p, pipe, model, 2, b"x", START + timedelta(minutes=n), a) for n, (i, p, pipe, model, a) in enumerate(rows)], EMBEDDING)


@pytest.fixture(scope="module")
def people(spark):
    return subjects(spark, [("p1", "Ann", "active", 1), ("p2", "Bob", "deleted", 2), ("p3", "Ann", "active", 3), ("p4", None, "active", 4), ("p5", "Eve", "active", 5)])


@pytest.fixture(scope="module")
def rows(spark):
    return embeddings(spark, [
        ("e1", "p1", "custom", "m", True), ("e2", "p1", "pretrained", "m", True), ("e3", "p1", "custom", "m", False),
        ("e4", "p2", "custom", "m", True), ("e5", "p3", "custom", "old", True),
    ])


def ids(df, name="id"):
    return sorted(r[name] for r in df.collect())


def test_one_live_row_of_five(people, rows):
    assert ids(gal.live_embeddings(rows, people, "custom", "m")) == ["e1"]
    assert ids(gal.live_embeddings(rows, people)) == ["e1", "e2", "e5"]


def test_stats(people, rows):
    found = {(r["pipeline"], r["model"]): (r["embeddings"], r["active_persons"]) for r in gal.gallery_stats(rows, people).collect()}
    assert found == {("custom", "m"): (1, None), ("pretrained", "m"): (1, None), ("custom", "old"): (1, None), (None, None): (3, 4)}


def test_deep_pages(people, monkeypatch):
    monkeypatch.setattr(gal, "SHALLOW_ROWS", 0)
    assert [[r["id"] for r in gal.page(people, 2, n, range_rows=1).orderBy("created_at").collect()] for n in (0, 2)] == [["p4", "p5"], ["p1", "p3"]]


def test_pages(people):
    first = gal.page(people, 2, 0).collect()
    assert [r["id"] for r in first] == ["p5", "p4"] and {r["total"] for r in first} == {4}
    assert [r["id"] for r in gal.page(people, 3, 3).collect()] == ["p1"]
    assert [r["id"] for r in gal.page(people, 3, 30).collect()] == ["p1"]
    assert gal.page(people, 3, 30, fix_offset=False).count() == 0
    assert [r["id"] for r in gal.page(people, 9, 0, "aN").collect()] == ["p3", "p1"]


@pytest.mark.parametrize("part_rows", [2, 100])
def test_profile_nests_all_embeddings(people, rows, part_rows):
    found = gal.profile(people, rows, part_rows, range_rows=2).collect()
    nested = {}
    for r in sorted(found, key=lambda r: (r["id"], r["part"])):
        assert len(r["embeddings"]) <= part_rows
        nested.setdefault(r["id"], []).extend(e["id"] for e in r["embeddings"])
    assert nested == {"p1": ["e1", "e2", "e3"], "p2": ["e4"], "p3": ["e5"], "p4": [], "p5": []}


def test_soft_delete_is_idempotent(spark, people, rows):
    gone = spark.createDataFrame([("p1",), ("p1",), ("p5",)], "id string")
    after, emb, affected = gal.soft_delete(people, rows, gone)
    assert ids(after.where("status = 'deleted'")) == ["p1", "p2", "p5"]
    assert ids(emb.where("is_active")) == ["e4", "e5"]
    assert [tuple(r) for r in affected.collect()] == [("p1", ["custom", "pretrained"])]
    again, emb2, affected2 = gal.soft_delete(after, emb, gone)
    assert ids(again.where("status = 'deleted'")) == ["p1", "p2", "p5"]
    assert affected2.count() == 0 and emb2.count() == 5


def test_duplicates_collapse_to_the_newest(people, rows):
    after, emb, affected = gal.collapse_duplicates(people, rows)
    assert ids(after.where("status = 'active'")) == ["p3", "p4", "p5"]
    assert affected.collect()[0]["affected"] == ["custom", "pretrained"]
    kept, _, _ = gal.collapse_duplicates(people, rows, keep="oldest")
    assert "p1" in ids(kept.where("status = 'active'"))


def test_deactivate(spark, people, rows):
    who = spark.createDataFrame([("p1",)], "id string")
    emb, affected = gal.deactivate(rows, who, ["custom"])
    assert ids(emb.where("is_active")) == ["e2", "e4", "e5"] and affected.first()[0] == ["custom"]
    emb, affected = gal.deactivate(rows, who)
    assert ids(emb.where("is_active")) == ["e4", "e5"] and affected.first()[0] == ["custom", "pretrained"]


BATCH = "request_id long, label string, pipeline string, model string, dim int, vector binary, created_at timestamp"


def test_enrol_reuses_the_newest_active_subject(spark, people, rows):
    batch = spark.createDataFrame(
        [(1, " Ann ", "custom", "m", 2, b"a", START), (1, " Ann ", "pretrained", "m", 2, b"a", START), (2, "Bob", "custom", "m", 2, b"b", START),
         (3, "New", "custom", "m", 2, b"c", START), (4, "New ", "custom", "m", 2, b"d", START), (5, None, "custom", "m", 2, b"e", START), (6, "  ", "custom", "m", 2, b"f", START)],
        BATCH,
    )
    people_after, emb = gal.enroll(people, rows, batch)
    new = people_after.join(people.select("id"), "id", "left_anti").collect()
    assert sorted(str(r["label"]) for r in new) == ["Bob", "New", "None", "None"]
    added = emb.join(rows.select("id"), "id", "left_anti")
    assert added.where("person_id = 'p3'").count() == 2 and added.count() == 7
    by_person = added.join(people_after.where("label = 'New'").select(F.col("id").alias("person_id")), "person_id", "left_semi")
    assert by_person.count() == 2 and by_person.select("person_id").distinct().count() == 1
    # the same label again finds the subject just made
    later = batch.where("request_id = 3").withColumn("request_id", F.lit(9).cast("long"))
    assert gal.enroll(people_after, emb, later)[0].count() == people_after.count()


def test_import_rows(spark, rows):
    new = embeddings(spark, [("n1", "p1", "custom", "m", True), ("n2", "p3", "custom", "m", True), ("n3", "p1", "other", "m", True)])
    assert ids(gal.import_rows(new, rows, "skip").where("id LIKE 'n%'")) == ["n2", "n3"]
    replaced = gal.import_rows(new, rows, "replace")
    assert ids(replaced.where("is_active")) == ["e2", "e4", "e5", "n1", "n2", "n3"]


def test_bulk_import(spark, people):
    emb = spark.createDataFrame([("e1", "p1", "custom", "m", 2, [1.0, 0.0], START, True)], EMBEDDING.replace("vector binary", "vector array<double>"))
    mapping = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "c")], "row_id long, identity string")
    vectors = spark.createDataFrame([(0, [3.0, 4.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0])], "row_id long, v array<double>")
    config = gal.ImportConfig("custom", "imp", "Bulk")
    stamp = F.lit(START)
    people_after, emb_after = gal.import_gallery(mapping, vectors, people, emb, config, stamp)
    assert sorted(r["label"] for r in people_after.where("label LIKE 'Bulk %'").collect()) == ["Bulk a", "Bulk b", "Bulk c"]
    added = emb_after.where("model = 'imp'")
    assert added.count() == 3 and sorted(r["vector"] for r in added.collect()) == [[0.0, 1.0], [0.6, 0.8], [1.0, 0.0]]
    with pytest.raises(ValueError):
        gal.import_gallery(mapping, vectors, people_after, emb_after, config, stamp)
    again = gal.import_gallery(mapping, vectors, people_after, emb_after, gal.ImportConfig("custom", "imp", "Bulk", True), stamp)
    assert ids(again[1]) == ids(emb_after) and ids(again[0]) == ids(people_after)
    other = gal.ImportConfig("pretrained", "imp", "Bulk", True)
    both = gal.import_gallery(mapping, vectors, people_after, emb_after, other, stamp)
    assert both[1].where("model = 'imp' AND pipeline = 'custom'").join(both[0].withColumnRenamed("id", "person_id"), "person_id", "left_semi").count() == 3
    beyond = spark.createDataFrame([(9, "z")], "row_id long, identity string")
    assert gal.missing_rows(beyond, vectors).count() == 1
    with pytest.raises(PySparkException):
        gal.import_join(beyond, vectors).collect()


@pytest.mark.parametrize("range_rows", [2, 100])
def test_build_plan(rows, range_rows):
    plan = gal.build_plan(rows.select("id", "created_at"), 2, 3, 4, range_rows).orderBy("position").collect()
    assert [(r["id"], r["batch_no"], r["in_training"]) for r in plan] == [("e1", 0, True), ("e2", 0, True), ("e3", 1, True), ("e4", 1, False)]


def test_coverage(spark, people, rows):
    snapshots = spark.createDataFrame([("custom", 9, 1), ("custom", 5, 2), ("other", 3, 1)], "pipeline string, embeddings_count long, created_at long")
    found = {r["pipeline"]: (r["templates"], r["indexed"], r["gap"]) for r in gal.index_coverage(rows, people, snapshots).collect()}
    assert found == {"custom": (2, 5, -3), "pretrained": (1, 0, 1), "other": (0, 3, -3)}


SNAPSHOT = "id int, family string, path string, pipeline string, model string, dim int, sha256 string, map_sha256 string, created_at int"


def test_newest_valid_snapshot(spark):
    rows = [
        (1, "f", "x/f.1.idx", "c", "m", 2, "h1", "g1", 1), (2, "f", "x/f.2.idx", None, None, None, None, None, 2),
        (3, "f", "x/f.3.idx", "c", "m", 2, "bad", None, 3), (4, "f", "x/f.4.idx", "c", "m", 2, "h4", "g4", 4),
        (5, "f", "x/f.5.idx", "other", "m", 2, "h5", "g5", 5), (6, "f", "x/f.6.idx", "c", "m", 2, "h6", "bad", 6),
    ]
    snapshots = spark.createDataFrame(rows, SNAPSHOT)
    # snapshot 4 has no map file
    files = [(f"x/f.{i}.idx", f"h{i}") for i in range(1, 7)] + [(f"x/f.{i}.idx.map.json", f"g{i}") for i in (1, 2, 3, 5, 6)]
    expected = spark.createDataFrame([("f", "c", "m", 2)], "family string, want_pipeline string, want_model string, want_dim int")
    newest = gal.latest_valid_snapshot(snapshots, spark.createDataFrame(files, "path string, sha256 string"), expected)
    assert [r["id"] for r in newest.collect()] == [2]


@pytest.mark.parametrize("range_rows", [2, 100])
def test_retention(spark, range_rows):
    snapshots = spark.createDataFrame([(i, f, f"{f}.{i}", i) for f in "ab" for i in range(5)], "id int, family string, path string, created_at int")
    old = gal.snapshot_retention(snapshots, 3, "a.0", range_rows)
    assert sorted(r["path"] for r in old.collect()) == ["a.1", "b.0", "b.1"]
    assert gal.snapshot_retention(snapshots, 0).count() == 0


@pytest.mark.parametrize("path, inside", [("d/i.bin", True), ("d/i.v1.bin", True), ("d/i2.bin", False), ("e/i.v1.bin", False), ("d/i.v1.txt", False)])
def test_path_family(spark, path, inside):
    assert spark.range(1).select(gal.in_family(F.lit(path), "d/i.bin")).first()[0] is inside
