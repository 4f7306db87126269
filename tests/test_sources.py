import hashlib
import json

import pytest
from pyspark.errors import PySparkException

from probewise.sources import files as src


def test_pairs_file(spark, tmp_path):
    path = tmp_path / "pairs.txt"
    path.write_text("10 300\nA 1 2\n\nA 1 B 1\n7\nC 3 4\nD 1 D 12345\n")
    rows = src.read_pairs(spark, str(path), "/img").orderBy("pair_id").collect()
    assert [(r["pair_id"], r["line_number"], r["label_same"]) for r in rows] == [(1, 2, 1), (2, 4, 0), (3, 6, 1), (4, 7, 0)]
    assert rows[1]["path1"] == "/img/A/A_0001.jpg" and rows[3]["path2"] == "/img/D/D_12345.jpg"


@pytest.mark.parametrize("bad", ["A B", "A 1 2 3 4", "A x 2", "name"])
def test_bad_pair_lines(spark, tmp_path, bad):
    path = tmp_path / "pairs.txt"
    path.write_text(f"A 1 2\n{bad}\nB 1 2\n")
    with pytest.raises(PySparkException, match="line 2"):
        src.read_pairs(spark, str(path), "/img").collect()
    assert src.read_pairs(spark, str(path), "/img", lenient=True).count() == 2


def test_manifest(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_bytes("﻿label,image_path,person_id\n Ann , a.jpg ,\n,b.jpg,1\nBob,,2\nEve,e.jpg, 7 \n".encode())
    rows = src.read_manifest(spark, str(path), ["label", "image_path"]).collect()
    assert sorted(tuple(r) for r in rows) == [("Ann", "a.jpg", ""), ("Eve", "e.jpg", "7")]
    with pytest.raises(ValueError, match="other"):
        src.read_manifest(spark, str(path), ["label", "other"])


def test_discovery(spark, tmp_path):
    for name in ("b/2.JPG", "a/1.png", "a/x.txt", "c/d/3.jpeg", "noext"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    rows = src.discover_files(spark, [str(tmp_path)], limit=2, range_rows=1).orderBy("position").collect()
    assert [(r["path"][len(str(tmp_path)) + 1 :], r["total"]) for r in rows] == [("a/1.png", 3), ("b/2.JPG", 3)]


def test_metrics(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"eer": 0.1, "run": "a"}, indent=2))
    (tmp_path / "two.json").write_text(json.dumps({"run": "b"}))
    (tmp_path / "bad.json").write_text('{"run": "c", ')
    rows = src.read_metrics(spark, f"{tmp_path}/*.json", "run string, eer double").collect()
    assert sorted((r["run"], r["eer"], r["file"]) for r in rows) == [("a", 0.1, "one.json"), ("b", None, "two.json")]


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_reports(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, 0.5, "x"), (2, None, "y")], "a long, b double, c string")
    src.write_report(df, str(tmp_path / "out"), fmt, ["b", "a"])
    reader = spark.read.schema("b double, a long")
    back = getattr(reader, fmt)(str(tmp_path / "out"), **({"header": True} if fmt == "csv" else {}))
    assert sorted(tuple(r) for r in back.collect() if r["b"]) == [(0.5, 1)] and back.count() == 2
    with pytest.raises(ValueError):
        src.write_report(df, str(tmp_path / "out"), "xml", ["a"])


def test_checksums(spark):
    good = hashlib.sha256(b"data").hexdigest()
    lines = spark.createDataFrame([(1, f"{good} *a"), (2, f"{good} *b"), (3, f"{good} *zz"), (4, "broken"), (5, "  ")], "line_number long, value string")
    stored = spark.createDataFrame([("a", b"data"), ("b", b"other")], "path string, content binary")
    found = src.verify_manifest(stored, src.parse_checksums(lines)).collect()
    assert {r["line_number"]: r["status"] for r in found} == {1: "ok", 2: "mismatch", 3: "missing", 4: "malformed"}


def test_json_manifest(spark, tmp_path):
    good = hashlib.sha256(b"data").hexdigest()
    files = [{"path": "a", "sha256": good}, {"path": "b", "sha256": "0"}, {"path": "c"}, {"sha256": good}]
    (tmp_path / "m.json").write_text(json.dumps({"name": "x", "files": files}, indent=1))
    stored = spark.createDataFrame([("a", b"data"), ("b", b"other")], "path string, content binary")
    found = src.verify_manifest(stored, src.read_manifest_files(spark, str(tmp_path / "m.json"))).collect()
    assert sorted((r["path"] or "", r["status"]) for r in found) == [("", "malformed"), ("a", "ok"), ("b", "mismatch"), ("c", "malformed")]


def test_lines_of_a_folder_have_their_numbers(spark, tmp_path):
    texts = {f"f{i}/part{j}.txt": [f"{i}-{j}-{n}" for n in range(n_lines)] for i, j, n_lines in ((0, 0, 3), (0, 1, 0), (1, 0, 500), (1, 1, 1))}
    for name, lines in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        # files are read in many splits
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
        for range_rows in (1_000_000, 40):
            rows = src.read_all_lines(spark, [str(tmp_path)], range_rows).collect()
            found = {}
            for r in rows:
                found.setdefault(r["path"][len(str(tmp_path)) + 1 :], {})[r["line_number"]] = r["value"]
            assert found == {name: dict(enumerate(lines, 1)) for name, lines in texts.items() if lines}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_pairs_and_checksums_of_a_folder(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.txt").write_text("10 300\nA 1 2\n\nA 1 B 1\n")
    (tmp_path / "p" / "b.txt").write_text("C 3 4\n")
    rows = src.read_pairs_folder(spark, [str(tmp_path / "p")], "/img").orderBy("pair_id").collect()
    assert [(r["path"][-5:], r["line_number"], r["pair_id"], r["label_same"]) for r in rows] == [("a.txt", 2, 1, 1), ("a.txt", 4, 2, 0), ("b.txt", 1, 3, 1)]
    (tmp_path / "p" / "c.txt").write_text("A 1 2\nnonsense here too many words\n")
    with pytest.raises(PySparkException, match=r"line 2 of .*c\.txt"):
        src.read_pairs_folder(spark, [str(tmp_path / "p")], "/img").collect()
    assert src.read_pairs_folder(spark, [str(tmp_path / "p")], "/img", lenient=True).count() == 4

    (tmp_path / "sums").mkdir()
    (tmp_path / "sums" / "x.sha256").write_text("ab *one.bin\n\nbroken\n")
    (tmp_path / "sums" / "y.sha256").write_text("cd *two.bin\n")
    sums = {(r["source"][-8:], r["line_number"], r["path"], r["expected"], r["ok"]) for r in src.read_checksums_folder(spark, [str(tmp_path / "sums")]).collect()}
    assert sums == {("x.sha256", 1, "one.bin", "ab", True), ("x.sha256", 3, None, None, False), ("y.sha256", 1, "two.bin", "cd", True)}

    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "m.json").write_text(json.dumps({"files": [{"path": "one.bin", "sha256": "ab"}, {"path": None, "sha256": "x"}]}, indent=1))
    (tmp_path / "json" / "other.json").write_text(json.dumps({"name": 1}))
    found = {(r["source"][-6:], r["path"], r["expected"]) for r in src.read_manifest_folder(spark, [str(tmp_path / "json")]).collect()}
    assert found == {("m.json", "one.bin", "ab"), ("m.json", None, "x")}
