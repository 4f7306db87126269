import os
import uuid
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from probewise.operators import datasets as ds


def files(spark, names):
    return spark.createDataFrame([(n.split("/")[0], n) for n in names], "identity string, path string")


def test_summary(spark):
    names = [f"p{i}/{j}.jpg" for i in range(7) for j in range(i % 3 + 1)]
    row = ds.dataset_summary(files(spark, names)).first()
    assert (row["identities"], row["images"], row["min_images"], row["avg_images"], row["max_images"]) == (7, 13, 1, 1.86, 3)
    assert row["samples"] == [f"p{i}/0.jpg" for i in range(5)]
    empty = ds.dataset_summary(files(spark, ["a/b"]).limit(0)).first()
    assert (empty["identities"], empty["images"], empty["avg_images"]) == (0, 0, 0.0)


@pytest.mark.parametrize("range_rows", [2, 100])
def test_prepare(spark, range_rows):
    named = [("1.jpg", "10"), ("2.jpg", "10"), ("3.jpg", "2"), ("4.jpg", "2"), ("5.jpg", "3"), ("6.jpg", "9"), ("7.jpg", "9"), ("x.jpg", "9")]
    present = spark.createDataFrame([(f"{i}.jpg",) for i in range(1, 8)], "filename string")
    identities = spark.createDataFrame(named, "filename string, identity string")
    codes = spark.createDataFrame([("1.jpg", "1"), ("2.jpg", "2"), ("3.jpg", "0"), ("4.jpg", "7")], "filename string, code string")
    found = sorted(tuple(r) for r in ds.prepare_dataset(present, identities, codes, 2, 2, range_rows).collect())
    # identities with two files in string order: "10", "2", "9"
    assert found == [("1.jpg", "10", "val"), ("2.jpg", "10", "test"), ("3.jpg", "2", "train"), ("4.jpg", "2", "train")]
    counts = {r["split"]: (r["images"], r["identities"]) for r in ds.split_counts(ds.prepare_dataset(present, identities, codes, 2)).collect()}
    assert counts == {"val": (1, 1), "test": (1, 1), "train": (4, 2)}


def test_split(spark):
    names = ["a/1.jpg", "a/2.jpg", "a/9.png", "a/8.png", "a/n.txt", "b/1.jpg"]
    found = {r["path"]: r["split"] for r in ds.split_per_identity(files(spark, names), 0.75, 2).collect()}
    assert found == {"a/8.png": "train", "a/9.png": "train", "a/1.jpg": "train", "a/2.jpg": "val", "b/1.jpg": "val"}


def test_class_numbers(spark):
    samples = files(spark, ["b/1", "a/1", "c/1", "a/2"])
    assert {r["identity"]: r["class_id"] for r in ds.class_index(samples, range_rows=2).collect()} == {"a": 0, "b": 1, "c": 2}
    given = ds.class_mapping(spark, {"a": 5, "b": 6})
    assert ds.class_index(samples, given, "skip").count() == 3
    with pytest.raises(PySparkException):
        ds.class_index(samples, given).collect()
    cache = spark.createDataFrame([("a/1", "ok", [1.0]), ("b/1", "no_face", None)], "path string, status string, v array<double>")
    assert [r["path"] for r in ds.with_teacher(samples, cache).collect()] == ["a/1"]


def test_extraction(spark):
    class Sizes(ds.Extractor):
        def extract(self, content):
            if content == b"boom":
                raise RuntimeError("broken file")
            if content == b"none":
                return "no_face", None
            return "ok", np.array([float(len(content)), 0.0]) if content != b"zero" else np.zeros(2)

    rows = [("d", b"boom"), ("b", b"none"), ("a", b"xyz"), ("c", b"zero"), ("e", b"xx")]
    out = ds.extract_embeddings(spark.createDataFrame(rows, "path string, content binary"), Sizes)
    assert {r["status"]: r["files"] for r in ds.outcome_counts(out).collect()} == {"ok": 2, "no_face": 1, "error": 2}
    good = ds.number_good_rows(out, 1).orderBy("row_id").collect()
    assert [(r["row_id"], r["path"], r["v"]) for r in good] == [(0, "a", [1.0, 0.0]), (1, "e", [1.0, 0.0])]
    assert sorted(r["path"] for r in ds.pending_files(out, out.where("status = 'ok'")).collect()) == ["b", "c", "d"]


def test_files_are_extracted_once_and_in_batches(spark, tmp_path):
    log = str(tmp_path / "calls")

    class Lengths(ds.Extractor):
        def extract_batch(self, contents):
            with open(log, "a") as out:
                out.write(f"{len(contents)}\n")
            if b"bad" in contents:
                raise RuntimeError("the whole batch fails")
            return [("ok", np.array([float(len(c)), 1.0])) for c in contents]

    rows = [(f"f{n}", b"x" * (n + 1)) for n in range(5)] + [("g", None)]
    files = spark.createDataFrame(rows, "path string, content binary").coalesce(1)
    out = ds.extract_embeddings(files, Lengths, batch_files=2)
    assert [r["row_id"] for r in ds.number_good_rows(out, 2).orderBy("path").collect()] == [0, 1, 2, 3, 4]
    assert {r["status"]: r["files"] for r in ds.outcome_counts(out).collect()} == {"ok": 5, "error": 1}
    assert open(log).read().split() == ["2", "2", "1"]
    mixed = spark.createDataFrame([("a", b"bad"), ("b", b"good")], "path string, content binary").coalesce(1)
    found = ds.extract_embeddings(mixed, Lengths).orderBy("path").collect()
    assert [r["status"] for r in found] == ["error", "ok"]


def test_batches(spark):
    rows = [(1, 1, "a", None), (1, 2, "b", "bad"), (2, 1, "c", None)]
    df = spark.createDataFrame(rows, "batch_id long, position long, file string, error string")
    assert sorted(tuple(r) for r in ds.batch_summary(df).collect()) == [(1, 2, 1, 1), (2, 1, 1, 0)]
    assert [tuple(r) for r in ds.batch_errors(df).collect()] == [(1, 2, "b", "bad")]


def test_a_lost_extraction_goes_on(spark, tmp_path):
    images, calls, broken = tmp_path / "images", tmp_path / "calls", tmp_path / "broken"
    images.mkdir()
    calls.mkdir()
    for n in range(7):
        (images / f"{n}.jpg").write_bytes(b"x" * (n + 1))
        os.utime(images / f"{n}.jpg", (1_700_000_000 + n, 1_700_000_000 + n))
    folder, flag = str(calls), str(broken)

    class Lengths(ds.Extractor):
        def __init__(self):
            if os.path.exists(flag) and len(os.listdir(folder)) >= 4:
                raise RuntimeError("the machine is gone")

        def extract(self, content):
            open(f"{folder}/{len(content)}-{uuid.uuid4()}", "w").close()
            return ("ok", np.array([float(len(content)), 1.0])) if len(content) != 3 else ("no_face", None)

    def run():
        files = ds.image_stream(spark, str(images), 2)
        ds.extract_stream(files, Lengths, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()

    broken.write_text("x")
    with pytest.raises(Exception, match="machine is gone"):
        run()
    done = len(os.listdir(folder))
    assert 0 < done < 7
    broken.rename(tmp_path / "mended")
    run()
    (images / "late.jpg").write_bytes(b"x" * 20)
    run()
    seen = sorted(int(name.split("-")[0]) for name in os.listdir(folder))
    assert seen == [1, 2, 3, 4, 5, 6, 7, 20]
    stored = spark.read.parquet(str(tmp_path / "out"))
    whole = spark.read.format("binaryFile").load(str(images)).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    batch = ds.extract_embeddings(whole, Lengths)
    assert sorted(tuple(r) for r in stored.collect()) == sorted(tuple(r) for r in batch.collect())
