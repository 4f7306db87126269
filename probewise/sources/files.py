"""File sources and sinks: discovery, pairs, manifests, metrics, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probewise.functions.labels import strip
from probewise.operators.ordered import RANGE_ROWS, row_numbers
from probewise.session import durable

# fixed values: image suffixes, image name pattern, checksum separator
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp")
INDEX_DIGITS = 4
IMAGE_SUFFIX = ".jpg"
CHECKSUM_SEPARATOR = " *"


def list_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(path, modificationTime, length)`` of all files below ``paths``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = reader.load(list(paths)).select("path", "modificationTime", "length")
    return found.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))


def discover_files(
    spark: SparkSession,
    paths: Sequence[str],
    suffixes: Sequence[str] = IMAGE_SUFFIXES,
    limit: int | None = None,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Files with an allowed suffix in path order, with the total before the limit."""
    suffix = F.regexp_extract(F.lower("path"), r"(\.[^./]*)$", 1)
    found = list_files(spark, paths).where(suffix.isin(*[s.lower() for s in suffixes]))
    total = found.agg(F.count(F.lit(1))).scalar()
    numbered = row_numbers(found, [("path", True)], (), "position", range_rows).withColumn("total", total)
    return numbered if limit is None else numbered.where(F.col("position") <= limit)


def image_path(root: Column, name: Column, index: Column) -> Column:
    """Image file of one numbered picture of a name."""
    number = index.cast("string")
    padded = F.when(F.length(number) < INDEX_DIGITS, F.lpad(number, INDEX_DIGITS, "0")).otherwise(number)
    return F.concat(root, F.lit("/"), name, F.lit("/"), name, F.lit("_"), padded, F.lit(IMAGE_SUFFIX))


def parse_pairs(lines: DataFrame, root: str, lenient: bool = False, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Verification pairs from ``(line_number, value)`` rows.

    Three tokens name two pictures of one identity, four tokens pictures of
    two; blank lines and lines of one or two numbers are skipped. Any other
    line raises with its number, or is skipped if ``lenient``. Lines of many
    files have a ``path``, which is kept and named in errors.
    """
    file = ["path"] if "path" in lines.columns else []
    tokens = F.split(strip("value"), r"\s+")
    rows = lines.withColumn("t", tokens).withColumn("n", F.size("t"))
    header = (F.col("n") <= 2) & F.forall("t", lambda t: t.rlike("^[0-9]+$"))
    rows = rows.where((strip("value") != "") & ~header)

    def number(position: Column) -> Column:
        return F.get("t", position).try_cast("int")

    same = F.col("n") == 3
    second = F.when(same, 2).otherwise(3)
    good = F.col("n").isin(3, 4) & number(F.lit(1)).isNotNull() & number(second).isNotNull()
    if lenient:
        rows = rows.where(good)
    else:
        message = F.concat(F.lit("unsupported pair at line "), F.col("line_number").cast("string"))
        if file:
            message = F.concat(message, F.lit(" of "), F.col("path"))
        rows = rows.where(F.when(good, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
    parsed = rows.select(
        *file,
        F.col("line_number").cast("long").alias("line_number"),
        same.cast("int").alias("label_same"),
        F.get("t", F.lit(0)).alias("name1"),
        number(F.lit(1)).alias("index1"),
        F.when(same, F.get("t", F.lit(0))).otherwise(F.get("t", F.lit(2))).alias("name2"),
        number(second).alias("index2"),
    )
    order = [(name, True) for name in (*file, "line_number")]
    numbered = row_numbers(parsed, order, (), "pair_id", range_rows)
    base = F.lit(root.rstrip("/"))
    return numbered.withColumns(
        {
            "path1": image_path(base, F.col("name1"), F.col("index1")),
            "path2": image_path(base, F.col("name2"), F.col("index2")),
        }
    )


def read_lines(spark: SparkSession, path: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``(line_number, value)`` of one text file.

    Spark numbers rows by split and place in the split, which for one file is
    the order of the lines; the running count closes the gaps.
    """
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    return row_numbers(lines, [("_at", True)], (), "line_number", range_rows).drop("_at")


def read_all_lines(spark: SparkSession, paths: Sequence[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``(path, line_number, value)`` of all text files of some folders, in one scan.

    Spark deals the files out in splits. A line's place in its file is that of its
    split and then its place there, and a file with very many lines is numbered
    in ranges. The lines are saved, so that the places stay as they are.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(list(paths)).select(
        F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("path"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"),
        "value",
    )
    order = [("_split", True), ("_at", True)]
    return row_numbers(durable(lines), order, ["path"], "line_number", range_rows).select("path", "line_number", "value")


def read_pairs_folder(spark: SparkSession, paths: Sequence[str], root: str, lenient: bool = False) -> DataFrame:
    """The pairs of all files of some folders; ``pair_id`` counts by file and line, errors name both."""
    return parse_pairs(read_all_lines(spark, paths), root, lenient)


def read_checksums_folder(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(source, line_number, path, expected, ok)`` of the checksum files of some folders."""
    lines = read_all_lines(spark, paths).withColumnRenamed("path", "source")
    return parse_checksums(lines)


def read_manifest_folder(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(source, path, expected)`` of the JSON manifests of some folders; files that are no manifest have none."""
    schema = "files array<struct<path: string, sha256: string>>"
    reader = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true")
    found = reader.json(list(paths)).select(F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("source"), "files")
    return found.select("source", F.inline("files")).select("source", "path", F.col("sha256").alias("expected"))


def read_pairs(spark: SparkSession, path: str, root: str, lenient: bool = False) -> DataFrame:
    return parse_pairs(read_lines(spark, path), root, lenient)


def read_manifest(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """Labelled CSV: required columns checked at once, cells trimmed, rows
    without a required cell dropped."""
    table = spark.read.csv(path, header=True, encoding="UTF-8", inferSchema=False)
    table = table.toDF(*[name.lstrip("﻿").strip() for name in table.columns])
    missing = sorted(set(required) - set(table.columns))
    if missing:
        raise ValueError(f"CSV is missing required columns: {', '.join(missing)}")
    table = table.select(*[F.coalesce(strip(name), F.lit("")).alias(name) for name in table.columns])
    for name in required:
        table = table.where(F.col(name) != "")
    return table


def write_report(df: DataFrame, path: str, fmt: str, columns: Sequence[str]) -> None:
    """Write a report with a fixed column order as csv, json or parquet."""
    writer = df.select(*columns).write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", "true").csv(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", "false").json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown report format {fmt!r}")


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Metric JSON files as one table with ``file``; unreadable files are left out."""
    table = (
        spark.read.schema(schema)
        .option("multiLine", "true")
        .option("mode", "DROPMALFORMED")
        .json(path)
        .withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    )
    return table


def parse_checksums(lines: DataFrame) -> DataFrame:
    """``(path, expected, line_number, ok)`` from ``<hex> *<path>`` lines; blanks skipped."""
    text = strip("value")
    place = F.instr(text, CHECKSUM_SEPARATOR)
    return lines.where(text != "").select(
        *[name for name in ("source", "line_number") if name in lines.columns],
        F.when(place > 0, F.substr(text, place + len(CHECKSUM_SEPARATOR))).alias("path"),
        F.when(place > 0, F.substr(text, F.lit(1), place - 1)).alias("expected"),
        (place > 0).alias("ok"),
    )


def read_manifest_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, expected)`` from the ``files`` list of a JSON manifest."""
    manifest = spark.read.schema("files array<struct<path: string, sha256: string>>").json(path, multiLine=True)
    return manifest.select(F.inline("files")).select("path", F.col("sha256").alias("expected"))


def verify_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Status of every manifest row ``(path, expected)`` against ``(path, content)``.

    ``ok``, ``missing``, ``mismatch``, or ``malformed`` for a row without a path.
    """
    actual = files.select("path", F.sha2("content", 256).alias("actual"))
    status = (
        F.when(F.col("path").isNull() | F.col("expected").isNull(), "malformed")
        .when(F.col("actual").isNull(), "missing")
        .when(F.col("actual") != F.col("expected"), "mismatch")
        .otherwise("ok")
    )
    return manifest.join(actual, "path", "left").withColumn("status", status)
