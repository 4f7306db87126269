"""From scored candidates to identity decisions.

Columns: ``image_id``, ``face_index``, ``probe_id`` (one face of one image),
``person_id``, ``label``, ``id`` (embedding), ``score``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probewise.functions.labels import identity_key, is_scale_label
from probewise.functions.vectors import as_column

# fixed values: (score, support) accept steps per space and number of faces
ACCEPT = {
    ("custom", False): ((0.36, 0), (0.32, 2), (0.30, 4)),
    ("custom", True): ((0.38, 0), (0.34, 2)),
    ("other", False): ((0.54, 0), (0.46, 2), (0.40, 3)),
    ("other", True): ((0.56, 0), (0.50, 2), (0.46, 3)),
}
# fixed values: (score below, margin below) and the margin needed without more support
AMBIGUOUS = {
    ("custom", False): ((0.34, 0.05), 0.035),
    ("custom", True): ((0.38, 0.08), 0.06),
    ("other", False): ((0.50, 0.055), None),
    ("other", True): ((0.56, 0.07), None),
}
# fixed values: support floor of the custom space
FLOOR_MIN, FLOOR_MARGIN = 0.18, 0.06
SCORE_DIGITS = 6


def per_case(pipeline: Column | str, multi: Column | str, rule) -> Column:
    """``rule(case)`` for the row's space and number of faces."""
    custom, multi = as_column(pipeline) == "custom", as_column(multi)
    return (
        F.when(custom & ~multi, rule(("custom", False)))
        .when(custom & multi, rule(("custom", True)))
        .when(~custom & ~multi, rule(("other", False)))
        .otherwise(rule(("other", True)))
    )


def support_floor(pipeline: Column | str, threshold: Column | str) -> Column:
    threshold = as_column(threshold)
    lowered = F.greatest(F.lit(FLOOR_MIN), F.round(threshold - FLOOR_MARGIN, SCORE_DIGITS))
    return F.when(as_column(pipeline) == "custom", lowered).otherwise(threshold)


def aggregate_identities(scored: DataFrame) -> DataFrame:
    """Best candidate and support count per probe and subject.

    Support counts candidates at or above the floor; on equal scores the
    smaller embedding id stands for the subject.
    """
    supports = F.col("score") >= support_floor("pipeline", "threshold")
    return scored.groupBy("image_id", "face_index", "probe_id", "person_id", "label", "pipeline", "threshold").agg(
        F.max("score").alias("score"),
        F.min(F.struct((-F.col("score")).alias("s"), F.col("id").alias("id")))["id"].alias("embedding_id"),
        F.sum(supports.cast("long")).alias("support_count"),
    )


def supported(
    pipeline: Column | str,
    score: Column | str,
    support: Column | str,
    threshold: Column | str,
    label: Column | str,
    multi: Column | str,
) -> Column:
    """Whether score and support are enough to name a subject."""
    score, support = as_column(score), as_column(support)

    def steps(case) -> Column:
        accepted = F.lit(False)
        for low, count in ACCEPT[case]:
            accepted = accepted | ((score >= low) & (support >= count))
        return accepted

    return (score >= as_column(threshold)) & ~is_scale_label(label) & per_case(pipeline, multi, steps)


def ambiguous(pipeline: Column, multi: Column, s1: Column, c1: Column, s2: Column, c2: Column) -> Column:
    """Whether the best subject is too close to the second; false without one."""
    margin = F.round(s1 - s2, SCORE_DIGITS)

    def close(case) -> Column:
        (low, gap), even_gap = AMBIGUOUS[case]
        result = (s1 < low) & (margin < gap)
        if even_gap is not None:
            result = result | ((c1 <= c2) & (margin < even_gap))
        return result

    return F.coalesce(per_case(pipeline, multi, close), F.lit(False))


def rank_window() -> Window:
    return Window.partitionBy("probe_id").orderBy(
        F.col("score").desc(), F.col("support_count").desc(), F.col("person_id").asc()
    )


def gate_identities(identities: DataFrame, faces: DataFrame) -> DataFrame:
    """Keep supported subjects; adds ``multi`` from the faces of each image.

    ``faces`` is ``(image_id, probe_id)`` with every processed face, also those
    without candidates.
    """
    counts = faces.groupBy("image_id").agg((F.count(F.lit(1)) > 1).alias("multi"))
    return identities.join(counts, "image_id").where(
        supported("pipeline", "score", "support_count", "threshold", "label", "multi")
    )


def with_ambiguity(gated: DataFrame) -> DataFrame:
    """Add ``rank`` and whether the probe's whole ranking is ambiguous."""
    best_two = (
        gated.withColumn("rank", F.row_number().over(rank_window()))
        .where(F.col("rank") <= 2)
        .groupBy("probe_id", "pipeline", "multi")
        .agg(
            *[
                F.max(F.when(F.col("rank") == n, F.col(name))).alias(f"{short}{n}")
                for n in (1, 2)
                for name, short in (("score", "s"), ("support_count", "c"))
            ]
        )
    )
    verdict = ambiguous(F.col("pipeline"), F.col("multi"), *[F.col(c) for c in ("s1", "c1", "s2", "c2")])
    return gated.join(best_two.select("probe_id", verdict.alias("ambiguous")), "probe_id")


def reject_ambiguous(gated: DataFrame) -> DataFrame:
    """Drop all subjects of a probe whose best is too close to the second."""
    return with_ambiguity(gated).where(~F.col("ambiguous")).drop("ambiguous")


def rank_identities(df: DataFrame, k: int) -> DataFrame:
    """The ``k`` best subjects per probe by score and support."""
    return df.withColumn("rank", F.row_number().over(rank_window())).where(F.col("rank") <= k)


def dedup_identities(df: DataFrame) -> DataFrame:
    """One row per identity and image: larger score, then support, then first face."""
    first = F.struct(
        (-F.col("score")).alias("a"), (-F.col("support_count")).alias("b"), "face_index", "rank", F.struct("*").alias("row")
    )
    keyed = df.withColumn("identity_key", identity_key("label", "person_id"))
    kept = keyed.select("image_id", "identity_key", first.alias("first")).groupBy("image_id", "identity_key")
    return kept.agg(F.min("first")["row"].alias("row")).select("row.*")


def summarize_search(results: DataFrame, probes: DataFrame) -> DataFrame:
    """One row per image.

    ``probes`` is ``(image_id, face_index, best_score, search_mode,
    candidate_k, fallback_reason)``; ``results`` are the accepted subjects.
    """
    modes = F.array_sort(F.collect_set("search_mode"))
    reasons = F.concat_ws(", ", F.array_sort(F.collect_set("fallback_reason")))
    raw = probes.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("faces_processed"),
        F.max("best_score").alias("_raw_best"),
        F.when(F.size(modes) > 1, "mixed").when(F.size(modes) == 1, modes[0]).otherwise("none").alias("search_mode"),
        F.max("candidate_k").alias("candidate_k"),
        F.when(reasons != "", reasons).alias("fallback_reason"),
    )
    accepted = results.groupBy("image_id").agg(
        F.count_distinct("face_index").alias("_matched"), F.max("score").alias("_best")
    )
    matched = F.coalesce(F.col("_matched"), F.lit(0))
    return raw.join(accepted, "image_id", "left").select(
        "image_id",
        "faces_processed",
        matched.alias("matched_faces"),
        F.when(matched > 0, "match").otherwise("unknown").alias("decision"),
        F.coalesce("_best", "_raw_best").alias("best_score"),
        "search_mode",
        "candidate_k",
        "fallback_reason",
    )


def annotate_detections(results: DataFrame, detections: DataFrame) -> DataFrame:
    """Display band of every detected face.

    ``results`` is ``(image_id, face_index, label, score, threshold)`` with any
    number of rows per face; ``detections`` is ``(image_id, face_index)``.
    """
    # fixed values: the weak band starts at max(0.2, 0.7 * threshold)
    score, threshold = F.col("score"), F.col("threshold")
    best = results.groupBy("image_id", "face_index").agg(
        F.min(F.struct(-score, "person_id", "label", "threshold"))["label"].alias("label"),
        F.max("score").alias("score"),
        F.max("threshold").alias("threshold"),
    )
    band = (
        F.when((score >= threshold) & (threshold > 0), "match")
        .when(score >= F.greatest(F.lit(0.2), F.round(threshold * 0.7, SCORE_DIGITS)), "weak")
        .otherwise("unknown")
    )
    return detections.select("image_id", "face_index").distinct().join(best, ["image_id", "face_index"], "left").select(
        "image_id",
        "face_index",
        F.when(score.isNull(), "No match").otherwise(F.col("label")).alias("label"),
        "score",
        F.when(score.isNull(), "unknown").otherwise(band).alias("quality"),
    )
