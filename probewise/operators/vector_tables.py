"""Whole-table vector checks: validation, parity, agreement, index size."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probewise.functions.vectors import VALID, cosine, l2_distance, max_abs_difference, norm, vector_problem

# fixed values: tolerances of the parity check
MAX_ABS_TOLERANCE = 1e-4
L2_TOLERANCE = 1e-5
NORM_TOLERANCE = 1e-3


def validate_vectors(df: DataFrame, dim: int, vec: str = "v") -> DataFrame:
    """Add ``reason``: ``ok`` or the first problem of the vector."""
    return df.withColumn("reason", vector_problem(vec, dim))


def validation_summary(validated: DataFrame) -> DataFrame:
    return validated.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def valid_rows(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reason") == VALID).drop("reason")


def parity_check(
    a: DataFrame,
    b: DataFrame,
    key: str,
    dim: int,
    max_abs: float = MAX_ABS_TOLERANCE,
    max_l2: float = L2_TOLERANCE,
    norm_tolerance: float = NORM_TOLERANCE,
) -> DataFrame:
    """Compare two vector tables ``(key, v)`` row by row."""
    joined = a.select(key, F.col("v").alias("_a")).join(b.select(key, F.col("v").alias("_b")), key)
    measured = joined.select(
        key,
        ((F.size("_a") == dim) & (F.size("_b") == dim)).alias("dim_ok"),
        F.round(max_abs_difference("_a", "_b"), 6).alias("max_abs_diff"),
        F.round(l2_distance("_a", "_b"), 6).alias("l2_diff"),
        F.round(norm("_a"), 6).alias("norm_a"),
    )
    agrees = (F.col("max_abs_diff") < max_abs) & (F.col("l2_diff") <= max_l2)
    norm_ok = F.round(F.abs(F.col("norm_a") - 1), 6) <= norm_tolerance
    return measured.withColumns({"norm_ok": norm_ok, "passed": F.col("dim_ok") & agrees & norm_ok})


def agreement_loss(student: DataFrame, teacher: DataFrame, key: str) -> DataFrame:
    """``1 - mean cosine`` over the keys both tables have with status ok."""
    rows = teacher.where(F.col("status") == "ok").select(key, F.col("v").alias("_t"))
    joined = student.select(key, F.col("v").alias("_s")).join(rows, key)
    return joined.agg(
        F.count(F.lit(1)).alias("pairs"), F.round(1 - F.avg(cosine("_s", "_t")), 6).alias("loss")
    )


def index_bytes(index_type: str, vectors: Column, dim: Column, params: Mapping[str, int] | None = None) -> Column:
    """Estimated bytes of an index; ``ivf`` is a flat one with its centroids."""
    params = params or {}
    flat = vectors * dim * 4
    return {
        "flat": flat,
        "hnsw": flat + vectors * params.get("m", 32) * 2 * 8,
        "ivf": flat + params.get("nlist", 0) * dim * 4,
        "ivfpq": F.floor(vectors * params.get("m", 16) * params.get("nbits", 8) / 8),
    }[index_type].cast("long")


def memory_estimate(df: DataFrame, index_type: str, params: Mapping[str, int] | None = None) -> DataFrame:
    """Estimated index bytes per space."""
    counts = df.groupBy("pipeline", "model").agg(F.count(F.lit(1)).alias("vectors"), F.max("dim").alias("dim"))
    size = index_bytes(index_type, F.col("vectors"), F.col("dim"), params)
    return counts.select("pipeline", "model", "vectors", size.alias("memory_bytes"))
