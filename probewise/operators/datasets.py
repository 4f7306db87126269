"""Training-set tables: filtering, splits, class numbers, extraction."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from probewise.functions.labels import identity_from_path
from probewise.operators.ordered import RANGE_ROWS, join_on, row_numbers
from probewise.session import durable

# fixed values: split codes, suffix order, summary size
SPLIT_CODES = {"0": "train", "1": "val", "2": "test"}
SUFFIX_ORDER = (".png", ".jpg")
SUMMARY_SAMPLES = 5
BATCH_FILES = 32


def infer_identity(files: DataFrame, roots: list[str]) -> DataFrame:
    return files.withColumn("identity", identity_from_path("path", roots))


def dataset_summary(files: DataFrame) -> DataFrame:
    """Counts over ``(identity, path)`` and the first image of the first identities."""
    per_identity = files.groupBy("identity").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"))
    samples = per_identity.orderBy("identity").limit(SUMMARY_SAMPLES)
    sampled = samples.agg(F.array_sort(F.collect_list(F.struct("identity", "first")))["first"].alias("s"))
    return per_identity.agg(
        F.count(F.lit(1)).alias("identities"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("images"),
        F.coalesce(F.min("n"), F.lit(0)).alias("min_images"),
        F.coalesce(F.round(F.avg("n"), 2), F.lit(0.0)).alias("avg_images"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_images"),
    ).withColumn("samples", sampled.scalar())


def prepare_dataset(
    files: DataFrame,
    identities: DataFrame,
    partitions: DataFrame,
    min_images: int = 1,
    max_identities: int = 0,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """``(filename, identity, split)`` of identities with enough images.

    ``identities`` is ``(filename, identity)``, ``partitions`` ``(filename,
    code)``. A cap keeps the first identities in string order; a file without
    a known code goes to train.
    """
    named = files.select("filename").distinct().join(identities, "filename")
    enough = named.groupBy("identity").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_images)
    if max_identities > 0:
        enough = row_numbers(enough, [("identity", True)], (), "_rank", range_rows).where(
            F.col("_rank") <= max_identities
        )
    split = F.lit("train")
    for code, name in SPLIT_CODES.items():
        split = F.when(F.col("code") == code, name).otherwise(split)
    return (
        named.join(enough.select("identity"), "identity", "left_semi")
        .join(partitions, "filename", "left")
        .select("filename", "identity", split.alias("split"))
    )


def split_counts(prepared: DataFrame) -> DataFrame:
    return prepared.groupBy("split").agg(
        F.count(F.lit(1)).alias("images"), F.count_distinct("identity").alias("identities")
    )


def split_per_identity(files: DataFrame, ratio: float, range_rows: int = RANGE_ROWS) -> DataFrame:
    """First ``int(n * ratio)`` files of each identity to train, the rest to val.

    Files count in suffix order, then by path; other suffixes are left out.
    """
    suffix = F.lit(None).cast("int")
    for number, ending in enumerate(SUFFIX_ORDER):
        suffix = F.when(F.col("path").endswith(ending), number).otherwise(suffix)
    known = files.withColumn("_s", suffix).where("_s IS NOT NULL")
    order = [("_s", True), ("path", True)]
    numbered = row_numbers(known, order, ["identity"], "_n", range_rows)
    sizes = known.groupBy("identity").agg(F.floor(F.count(F.lit(1)) * F.lit(float(ratio))).alias("_train"))
    split = F.when(F.col("_n") <= F.col("_train"), "train").otherwise("val")
    return join_on(numbered, sizes, ["identity"]).withColumn("split", split).drop("_s", "_n", "_train")


def class_index(
    samples: DataFrame,
    mapping: DataFrame | None = None,
    on_unknown: str = "error",
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Add ``class_id``: the 0-based rank of the class name, or the given mapping.

    ``mapping`` is ``(identity, class_id)``; unknown classes raise or are skipped.
    """
    if mapping is None:
        names = samples.select("identity").distinct()
        mapping = row_numbers(names, [("identity", True)], (), "class_id", range_rows).withColumn(
            "class_id", F.col("class_id") - 1
        )
    if on_unknown == "skip":
        return samples.join(mapping, "identity")
    problem = F.raise_error(F.concat(F.lit("unknown class: "), F.col("identity"))).cast("long")
    joined = samples.join(mapping, "identity", "left")
    return joined.withColumn("class_id", F.when(F.col("class_id").isNull(), problem).otherwise(F.col("class_id").cast("long")))


def with_teacher(samples: DataFrame, cache: DataFrame) -> DataFrame:
    """Samples that have a usable cached vector ``(path, status, v)``."""
    return samples.join(cache.where("status = 'ok'").select("path", F.col("v").alias("teacher")), "path")


Outcome = tuple[str, np.ndarray | None]


EXTRACTED = "path string, status string, v array<double>"


class Extractor:
    """Turns file contents into ``(status, vector)``; subclass and override one method."""

    def extract(self, content: bytes) -> Outcome:
        raise NotImplementedError

    def extract_batch(self, contents: list[bytes]) -> list[Outcome]:
        """One outcome per file, for models that take many files at once."""
        return [one_outcome(self, content) for content in contents]


def extract_embeddings(
    files: DataFrame, factory: Callable[[], Extractor], batch_files: int = BATCH_FILES
) -> DataFrame:
    """Run a pluggable extractor over ``(path, content)``.

    The extractor is built once per task and gets up to ``batch_files`` files
    in a call. A failing file gets a status and does not fail the job; a batch
    that fails is tried again file by file. Vectors must be finite and not
    zero. The result is written once, so later steps don't extract again.
    """

    return durable(extracted_rows(files, factory, batch_files))


def extracted_rows(files: DataFrame, factory: Callable[[], Extractor], batch_files: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor = factory()
        for batch in batches:
            contents = batch["content"].tolist()
            rows = [
                row
                for start in range(0, len(contents), batch_files)
                for row in extract_files(extractor, contents[start : start + batch_files])
            ]
            yield pd.DataFrame(
                {"path": batch["path"], "status": [r[0] for r in rows], "v": [r[1] for r in rows]}
            )

    return files.select("path", "content").mapInPandas(run, EXTRACTED)


def extract_stream(
    files: DataFrame, factory: Callable[[], Extractor], path: str, checkpoint: str, batch_files: int = BATCH_FILES
) -> StreamingQuery:
    """Extract a stream of files to parquet, batch by batch, all that is there now.

    The checkpoint knows the files that are done. A job that is lost, and started
    again with it, goes on with the first batch that is not written; files that come
    later are extracted alone. The outcome is that of ``extract_embeddings``.
    """
    return (
        extracted_rows(files, factory, batch_files)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def image_stream(spark: SparkSession, path: str, files_per_batch: int) -> DataFrame:
    """``(path, content)`` of the files below a folder, as a stream."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
    found = reader.option("maxFilesPerTrigger", files_per_batch).load(path)
    return found.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")


def one_outcome(extractor: Extractor, content: bytes) -> Outcome:
    try:
        return extractor.extract(content)
    except Exception:  # a broken file is an outcome, not a failure
        return "error", None


def extract_files(extractor: Extractor, contents: list[bytes | None]) -> list[Outcome]:
    """Checked outcomes of some files; missing contents are errors."""
    known = [bytes(content) for content in contents if content is not None]
    found = iter(batch_outcomes(extractor, known) if known else [])
    return [("error", None) if content is None else checked_outcome(*next(found)) for content in contents]


def batch_outcomes(extractor: Extractor, contents: list[bytes]) -> list[Outcome]:
    try:
        found = list(extractor.extract_batch(contents))
    except Exception:
        if len(contents) == 1:
            return [("error", None)]
        return [outcome for content in contents for outcome in batch_outcomes(extractor, [content])]
    if len(found) != len(contents):
        raise ValueError(f"{len(found)} outcomes for {len(contents)} files")
    return found


def checked_outcome(status: str, vector: np.ndarray | None) -> Outcome:
    if status != "ok":
        return status, None
    vector = np.asarray(vector, dtype=float)
    length = float(np.linalg.norm(vector)) if vector.ndim == 1 else 0.0
    if not np.isfinite(length) or length <= 0:
        return "error", None
    return "ok", vector / length


def outcome_counts(extracted: DataFrame) -> DataFrame:
    return extracted.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def number_good_rows(extracted: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Consecutive ``row_id`` from 0 over the good rows, in path order."""
    good = extracted.where("status = 'ok'").drop("status")
    numbered = row_numbers(good, [("path", True)], (), "row_id", range_rows)
    return numbered.withColumn("row_id", F.col("row_id") - 1)


def pending_files(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files without a cached vector."""
    return files.join(cache.select("path"), "path", "left_anti")


def batch_summary(rows: DataFrame) -> DataFrame:
    """Requested, succeeded and failed files of ``(batch_id, position, file, error)``."""
    failed = F.col("error").isNotNull()
    return rows.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("requested"),
        F.sum((~failed).cast("long")).alias("succeeded"),
        F.sum(failed.cast("long")).alias("failed"),
    )


def batch_errors(rows: DataFrame) -> DataFrame:
    """The per-file error list, one row per failed file."""
    return rows.where("error IS NOT NULL").select("batch_id", "position", "file", "error")


def class_mapping(spark, names: Mapping[str, int]) -> DataFrame:
    return spark.createDataFrame(list(names.items()), "identity string, class_id long")
