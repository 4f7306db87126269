"""Galleries that are changed in place: only touched partitions are written, and a repeat writes nothing."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from probewise.operators import gallery as g
from probewise.sources.store import EMBEDDINGS, SUBJECTS, GalleryStore, bucket_of, open_or_create

SUBJECT = "id string, label string, status string, created_at timestamp, updated_at timestamp"
EMBEDDING = "id string, person_id string, pipeline string, model string, dim int, vector binary, created_at timestamp, is_active boolean"
T0 = datetime(2024, 1, 1)


@pytest.fixture
def tables(spark):
    people = [(f"s{i}", f"L{i % 35}", "active" if i % 7 else "deleted", T0.replace(day=1 + i % 28), T0) for i in range(40)]
    rows = [(f"e{i}", f"s{i % 40}", "custom" if i % 3 else "pretrained", "m", 4, None, T0, i % 5 > 0) for i in range(200)]
    rows.append(("lone", None, "custom", "m", 4, None, T0, True))
    return spark.createDataFrame(people, SUBJECT), spark.createDataFrame(rows, EMBEDDING)


@pytest.fixture
def store(spark, tables, tmp_path):
    return GalleryStore.create(str(tmp_path / "store"), *tables, buckets=16)


def files(store):
    out = {}
    for top, _, names in os.walk(store.path):
        out |= {f"{top}/{n}": os.stat(f"{top}/{n}").st_mtime_ns for n in names if n.endswith(".parquet") and "bucket=" in top}
    return out


def buckets_written(store, before):
    return {f.split("bucket=")[1].split("/")[0] for f, t in files(store).items() if before.get(f) != t}


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


PERSON, ROW = ("id", "label", "status"), ("id", "person_id", "pipeline", "is_active")


def test_deleting_writes_its_partitions_only(spark, store, tables):
    ids = spark.createDataFrame([("s1",), ("s2",), ("s2",), ("absent",)], "id string")
    people, rows, _ = g.soft_delete(*tables, ids)
    before = files(store)
    touched = store.soft_delete(ids)
    own = {r["b"] for r in ids.where("id <> 'absent'").select(bucket_of(F.col("id"), 16).alias("b")).collect()}
    assert set(touched[SUBJECTS]) == own and set(touched[EMBEDDINGS]) == own
    assert buckets_written(store, before) == {str(b) for b in own}
    assert rows_of(store.subjects, *PERSON) == rows_of(people, *PERSON)
    assert rows_of(store.embeddings, *ROW) == rows_of(rows, *ROW)
    # again: nothing is written
    before = files(store)
    assert store.soft_delete(ids) == {SUBJECTS: [], EMBEDDINGS: []} and files(store) == before
    assert store.soft_delete(ids.limit(0)) == {SUBJECTS: [], EMBEDDINGS: []}


def test_collapse_and_deactivate_in_place(spark, store, tables):
    people, rows, _ = g.collapse_duplicates(*tables)
    store.collapse_duplicates()
    assert rows_of(store.subjects, *PERSON) == rows_of(people, *PERSON)
    assert rows_of(store.embeddings, *ROW) == rows_of(rows, *ROW)
    assert store.collapse_duplicates() == {SUBJECTS: [], EMBEDDINGS: []}
    persons = spark.createDataFrame([("s3",), ("s4",)], "id string")
    rows, _ = g.deactivate(store.embeddings, persons, ["custom"])
    wanted = rows_of(rows, *ROW)
    assert len(store.deactivate(persons, ["custom"])) <= 2
    assert rows_of(store.embeddings, *ROW) == wanted
    assert store.deactivate(persons, ["custom"]) == []


def test_a_batch_is_enrolled_once(spark, store, tables):
    batch = spark.createDataFrame(
        [("r1", "L3", "custom", "m", 4, None, T0), ("r2", "new", "custom", "m", 4, None, T0), ("r3", "new", "pretrained", "m", 4, None, T0), ("r4", None, "custom", "m", 4, None, T0)],
        "request_id string, label string, pipeline string, model string, dim int, vector binary, created_at timestamp",
    )
    people, rows = g.enroll(*tables, batch)
    before = files(store)
    touched = store.enroll(batch)
    # nothing that was there is written again
    assert all(files(store)[f] == t for f, t in before.items())
    assert 1 <= len(touched[SUBJECTS]) <= 2 and 1 <= len(touched[EMBEDDINGS]) <= 3
    assert rows_of(store.subjects, *PERSON) == rows_of(people, *PERSON)
    assert rows_of(store.embeddings, *ROW) == rows_of(rows, *ROW)
    assert store.enroll(batch) == {SUBJECTS: [], EMBEDDINGS: []}
    assert rows_of(store.embeddings, *ROW) == rows_of(rows, *ROW)


@pytest.mark.parametrize("mode", ["skip", "replace"])
def test_rows_are_imported_once(spark, store, tables, mode):
    new = spark.createDataFrame([(f"n{i}", f"s{i}", "custom", "m", 4, None, T0, True) for i in (1, 2, 60)], EMBEDDING)
    wanted = rows_of(g.import_rows(new, tables[1], mode), *ROW)
    touched = store.import_rows(new, mode)
    assert rows_of(store.embeddings, *ROW) == wanted
    assert bool(touched["switched_off"]) == (mode == "replace")
    before = files(store)
    assert store.import_rows(new, mode) == {"switched_off": [], "added": []} and files(store) == before


def test_stores_are_opened_again_and_may_be_empty(spark, tables, tmp_path):
    people, rows = (t.limit(0) for t in tables)
    path = str(tmp_path / "empty")
    store = open_or_create(path, people, rows, 8)
    assert store.subjects.count() == 0 and store.embeddings.columns == rows.columns
    again = open_or_create(path, *tables, 32)
    assert again.buckets == 8 and again.embeddings.count() == 0
    assert again.import_rows(tables[1].limit(3))["added"]
    assert GalleryStore(spark, path).embeddings.count() == 3
