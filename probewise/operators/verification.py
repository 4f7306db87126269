"""Verification metrics over scored pairs ``(score, label)``, label 1 = same.

``score >= threshold`` is a match. Every operator takes ``by``, the columns of
separate evaluations (for example the space). Undefined rates are null.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from probewise.operators.ordered import RANGE_ROWS, join_on, row_numbers, running_sums
from probewise.session import durable

# fixed values: reported false-accept targets, grid of the k-fold protocol
TARGET_FARS = (0.1, 0.01, 0.001)
FOLD_TARGET_FARS = (0.1, 0.01, 0.001, 0.0001)
GRID_STEPS = 4000
ROC_POINTS = 401

COUNTS = ("tp", "fp", "tn", "fn")
RATES = ("far", "frr", "tar", "accuracy")


@F.pandas_udf(T.DoubleType())
def _next_below(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in values:
        yield pd.Series(np.nextafter(batch.to_numpy(), -np.inf))


@F.pandas_udf(T.DoubleType())
def _next_above(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in values:
        yield pd.Series(np.nextafter(batch.to_numpy(), np.inf))


def is_finite(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))


def usable_pairs(scored: DataFrame) -> DataFrame:
    """The pairs all metrics are about: a finite score and label 0 or 1."""
    return scored.where(is_finite(F.col("score")) & F.col("label").isin(0, 1))


def unusable_pairs(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, pairs, unscored, not_finite, other_label)``: what the metrics leave out, each pair counted once."""
    score = F.col("score")
    labelled = F.coalesce(F.col("label").isin(0, 1), F.lit(False))
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(score.isNull()).alias("unscored"),
        F.count_if(score.isNotNull() & ~is_finite(score)).alias("not_finite"),
        F.count_if(is_finite(score) & ~labelled).alias("other_label"),
    )


def score_histogram(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Positive and negative pairs per distinct score of the usable pairs."""
    return usable_pairs(scored).groupBy(*by, "score").agg(
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("neg"),
    )


def default_thresholds(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct scores and one value beyond either end."""
    scores = score_histogram(scored, by).select(*by, F.col("score").alias("threshold"))
    ends = scores.groupBy(*by).agg(F.min("threshold").alias("low"), F.max("threshold").alias("high"))
    outside = [
        ends.where("low IS NOT NULL").select(*by, edge.alias("threshold"))
        for edge in (_next_below("low"), _next_above("high"))
    ]
    return scores.unionByName(outside[0]).unionByName(outside[1])


def confusion_curve(
    scored: DataFrame,
    thresholds: DataFrame | None = None,
    by: Sequence[str] = (),
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Counts at every threshold: ``(by…, position, threshold, tp, fp, tn, fn)``.

    ``thresholds`` is ``(position, threshold)``, the same for all groups, in
    the order the caller listed them; without it the default grid is used.
    Thresholds ride along with the score histogram through one running sum.
    """
    by = list(by)
    histogram = durable(score_histogram(scored, by))
    if thresholds is None:
        grid = default_thresholds(histogram.select(*by, "score", F.lit(0).alias("label")), by)
        grid = grid.withColumn("position", F.lit(None).cast("long"))
    else:
        listed = F.collect_list(F.struct(F.col("position").cast("long").alias("position"), "threshold"))
        grid = thresholds if not by else (
            histogram.select(*by).distinct().select(*by, F.inline(thresholds.agg(listed).scalar()))
        )
    zero = F.lit(0).cast("long")
    marks = histogram.select(*by, F.col("score").alias("threshold"), "pos", "neg", zero.alias("mark"), F.lit(None).cast("long").alias("position"))
    asked = grid.select(*by, "threshold", zero.alias("pos"), zero.alias("neg"), F.lit(1).cast("long").alias("mark"), "position")
    order = [("threshold", False), ("mark", True)]
    summed = running_sums(marks.unionByName(asked), order, {"pos": "tp", "neg": "fp"}, by, range_rows).where("mark = 1")
    sums = [F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg")]
    if by:
        joined = join_on(summed, histogram.groupBy(*by).agg(*sums), by)
    else:
        totals = {f"_{c}": histogram.agg(F.sum(c)).scalar() for c in ("pos", "neg")}
        joined = summed.withColumns(totals)
    curve = joined.select(
        *by, "position", "threshold", "tp", "fp", (F.col("_neg") - F.col("fp")).alias("tn"), (F.col("_pos") - F.col("tp")).alias("fn")
    )
    # with the default grid the order of the list is the order of the values
    return curve if thresholds is not None else curve.drop("position")


def rate_columns(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    return {
        "far": F.try_divide(fp, fp + tn),
        "frr": F.try_divide(fn, tp + fn),
        "tar": F.try_divide(tp, tp + fn),
        "accuracy": F.try_divide(tp + tn, tp + fp + tn + fn),
    }


def rate_curve(
    scored: DataFrame, thresholds: DataFrame | None = None, by: Sequence[str] = (), range_rows: int = RANGE_ROWS
) -> DataFrame:
    """The confusion curve with FAR, FRR, TAR and accuracy."""
    curve = confusion_curve(scored, thresholds, by, range_rows)
    return curve.withColumns(rate_columns(*[F.col(c) for c in COUNTS]))


def _list_order(curve: DataFrame) -> Column:
    return F.col("position") if "position" in curve.columns else F.col("threshold")


def _first_best(value: Column, curve: DataFrame, names: Sequence[str]) -> Column:
    """Struct of ``names`` at the largest ``value``, first in list order on ties."""
    ranked = F.struct((-value).alias("_v"), _list_order(curve).alias("_o"), *names)
    return F.min(F.when(value.isNotNull(), ranked))


def best_accuracy(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Threshold of the highest accuracy on a rate curve."""
    names = ["threshold", "accuracy", *COUNTS, "far", "frr"]
    return curve.groupBy(*by).agg(_first_best(F.col("accuracy"), curve, names).alias("b")).select(
        *by, *[F.col(f"b.{name}").alias(name) for name in names]
    )


def equal_error_rate(curve: DataFrame, by: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """Error rate where FAR and FRR meet: ``(by…, eer, threshold, far, frr)``.

    FAR never rises and FRR never falls with the threshold, so the crossing
    lies between the last point with FAR > FRR and the first with FAR < FRR;
    one aggregation finds both. ``strict`` raises where a class is missing.
    """
    gap = F.col("far") - F.col("frr")
    point = F.struct("threshold", "far", "frr", gap.alias("gap"))
    spots = curve.groupBy(*by).agg(
        F.min(F.when(gap == 0, point)).alias("zero"),
        F.max(F.when(gap > 0, point)).alias("left"),
        F.min(F.when(gap < 0, point)).alias("right"),
        F.min(F.when(gap.isNotNull(), F.struct(F.abs(gap).alias("_d"), "threshold", "far", "frr"))).alias("near"),
    )
    ratio = -F.col("left.gap") / (F.col("right.gap") - F.col("left.gap"))

    def between(name: str) -> Column:
        left, right = F.col(f"left.{name}"), F.col(f"right.{name}")
        return left + ratio * (right - left)

    crosses = F.col("left").isNotNull() & F.col("right").isNotNull()
    chosen = {
        name: F.when(F.col("zero").isNotNull(), F.col(f"zero.{name}"))
        .when(crosses, between(name))
        .otherwise(F.col(f"near.{name}"))
        for name in ("threshold", "far", "frr")
    }
    eer = (chosen["far"] + chosen["frr"]) / 2
    if strict:
        problem = F.raise_error(F.lit("equal error rate needs positive and negative pairs")).cast("double")
        eer = F.when(F.col("near").isNull(), problem).otherwise(eer)
    return spots.select(*by, eer.alias("eer"), *[c.alias(name) for name, c in chosen.items()])


def tar_at_far(curve: DataFrame, targets: Sequence[float] = TARGET_FARS, by: Sequence[str] = ()) -> DataFrame:
    """Highest TAR among thresholds with FAR at or below each target.

    A target no threshold meets gives a row of nulls.
    """
    names = ["threshold", "far", "frr", "tar"]
    picks = [
        _first_best(F.when(F.col("far") <= target, F.coalesce("tar", F.lit(-1.0))), curve, names) for target in targets
    ]
    rows = F.array(*[F.struct(F.lit(float(t)).alias("target_far"), p.alias("b")) for t, p in zip(targets, picks)])
    return (
        curve.groupBy(*by)
        .agg(rows.alias("rows"))
        .select(*by, F.inline("rows"))
        .select(*by, "target_far", "b.tar", "b.threshold", "b.far", "b.frr")
    )


def roc_points(
    curve: DataFrame, max_points: int = ROC_POINTS, by: Sequence[str] = (), range_rows: int = RANGE_ROWS
) -> DataFrame:
    """At most ``max_points`` evenly spaced points of a rate curve."""
    by = list(by)
    points = curve.select(*by, "threshold", "far", "frr", "tar").distinct()
    numbered = durable(row_numbers(points, [("threshold", True)], by, "point", range_rows)).withColumn(
        "point", F.col("point") - 1
    )
    sizes = numbered.groupBy(*by).agg(F.count(F.lit(1)).alias("_m"))
    step = (F.col("_m") - 1) / F.lit(max_points - 1)
    wanted = sizes.select(
        *by,
        F.when(F.col("_m") <= max_points, F.sequence(F.lit(0).cast("long"), F.least("_m", F.lit(max_points)) - 1))
        .otherwise(
            F.transform(
                F.sequence(F.lit(0), F.lit(max_points - 1)),
                lambda i: F.when(i == max_points - 1, F.col("_m") - 1).otherwise(F.floor(i * step)),
            )
        )
        .alias("point"),
    ).select(*by, F.explode("point").alias("point"))
    return numbered.join(wanted, [*by, "point"], "left_semi").select(*by, "threshold", "far", "frr", "tar")


def roc_auc(scored: DataFrame, by: Sequence[str] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """Area under the ROC curve; ties between classes count one half."""
    by = list(by)
    histogram = durable(score_histogram(scored, by))
    ranked = running_sums(histogram, [("score", True)], {"neg": "_upto"}, by, range_rows)
    below = (F.col("_upto") - F.col("neg")).cast("double") + F.col("neg") / 2
    return ranked.groupBy(*by).agg(
        F.try_divide(
            F.sum(F.col("pos") * below), F.sum("pos").cast("double") * F.sum("neg").cast("double")
        ).alias("auc")
    )


def verification_summary(rows: DataFrame, by: Sequence[str] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per evaluation from pair rows ``(score, status, label)``."""
    by = list(by)
    valid = rows.where(F.col("status") == "ok").select(*by, "score", "label")
    curve = durable(rate_curve(valid, None, by, range_rows))
    ok, same = F.col("status") == "ok", F.col("label") == 1
    base = rows.groupBy(*by).agg(
        F.sum(ok.cast("long")).alias("valid_pairs"),
        F.sum((ok & same).cast("long")).alias("positive_pairs"),
        F.sum((ok & ~same).cast("long")).alias("negative_pairs"),
        F.sum((~ok).cast("long")).alias("skipped_pairs"),
        F.round(F.avg(F.when(ok & same, F.col("score"))), 6).alias("mean_positive_score"),
        F.round(F.avg(F.when(ok & ~same, F.col("score"))), 6).alias("mean_negative_score"),
    )

    def six(name: str, out: str) -> Column:
        return F.round(name, 6).alias(out)

    eer = equal_error_rate(curve, by).select(
        *by, six("eer", "eer"), six("threshold", "eer_threshold"), six("far", "eer_far"), six("frr", "eer_frr")
    )
    best = best_accuracy(curve, by).select(
        *by,
        six("accuracy", "best_accuracy"),
        six("threshold", "best_accuracy_threshold"),
        six("far", "far_at_best_threshold"),
        six("frr", "frr_at_best_threshold"),
    )
    tars = tar_at_far(curve, TARGET_FARS, by).groupBy(*by).agg(
        *[
            F.round(F.max(F.when(F.col("target_far") == t, F.col("tar"))), 6).alias("tar_at_far_" + f"{t:g}".replace(".", "_"))
            for t in TARGET_FARS
        ]
    )
    result = base
    for part in (eer, best, tars):
        if by:
            # a group with one class has no rates
            result = join_on(result, part, by, "left")
        else:
            one = F.lit(1)
            result = result.withColumn("_k", one).join(part.withColumn("_k", one), "_k").drop("_k")
    return result


def cap_pairs(pairs: DataFrame, limit: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """At most ``limit`` pairs by ``pair_id``, half of them positive.

    Without one of the classes, or with few pairs, the first ``limit`` pairs.
    """
    order = [("pair_id", True)]
    numbered = row_numbers(pairs, order, ["label_same"], "_in_class", range_rows)
    numbered = row_numbers(numbered, order, [], "_overall", range_rows)
    totals = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label_same").alias("classes"))
    balanced = totals.select((F.col("n") > limit) & (F.col("classes") == 2)).scalar()
    share = F.when(F.col("label_same") == 1, limit // 2).otherwise(limit - limit // 2)
    kept = F.when(F.lit(True) & balanced, F.col("_in_class") <= share).otherwise(F.col("_overall") <= limit)
    return numbered.where(kept).select(*pairs.columns)


def grid_threshold(step: Column) -> Column:
    return (step - GRID_STEPS // 2) / (GRID_STEPS / 2)


def grid_bin(score: Column) -> Column:
    """Number of the last grid threshold at or below the score; -1 below the grid."""
    guess = F.least(F.greatest(F.floor(score * (GRID_STEPS / 2)) + GRID_STEPS // 2, F.lit(-1)), F.lit(GRID_STEPS))
    guess = guess.cast("int")
    return (
        F.when((guess < GRID_STEPS) & (grid_threshold(guess + 1) <= score), guess + 1)
        .when((guess >= 0) & (grid_threshold(guess) > score), guess - 1)
        .otherwise(guess)
    )


def fold_histogram(pairs: DataFrame, folds: int) -> DataFrame:
    """``(fold, bin, pos, neg)`` of the usable pairs: at most ``folds * grid`` rows, however many pairs."""
    total = pairs.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / max(folds, 1)))).scalar()
    fold = F.least(F.floor((F.col("pair_id") - 1) / total), F.lit(max(folds - 1, 0))).cast("int")
    binned = (
        pairs.withColumn("fold", fold)
        .where(F.col("status") == "ok")
        .groupBy("fold", grid_bin(F.col("score")).alias("bin"))
        .agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    )
    return durable(binned)


def fold_points(binned: DataFrame) -> DataFrame:
    """One row per fold and grid threshold: counts and rates of the other folds and of the fold itself."""
    steps = F.sequence(F.lit(-1), F.lit(GRID_STEPS))
    frame = binned.select("fold").distinct().select("fold", F.explode(steps).alias("bin"))
    filled = frame.join(binned, ["fold", "bin"], "left").fillna(0, ["pos", "neg"])
    from_here = _upward(filled, ["fold"])
    whole = from_here.groupBy("bin").agg(
        *[F.sum(c).alias(f"all_{c}") for c in ("acc_pos", "acc_neg")],
    )
    sums = filled.groupBy("fold").agg(F.sum("pos").alias("fold_pos"), F.sum("neg").alias("fold_neg"))
    grand = sums.agg(F.sum("fold_pos").alias("p"), F.sum("fold_neg").alias("n"))
    return (
        from_here.where("bin >= 0")
        .join(whole, "bin")
        .join(sums, "fold")
        .withColumn("train_pos", grand.select("p").scalar() - F.col("fold_pos"))
        .withColumn("train_neg", grand.select("n").scalar() - F.col("fold_neg"))
        .where("train_pos + train_neg > 0")
        .withColumn("threshold", grid_threshold(F.col("bin")))
        .withColumn("tp", F.col("all_acc_pos") - F.col("acc_pos"))
        .withColumn("fp", F.col("all_acc_neg") - F.col("acc_neg"))
        .withColumn("accuracy", (F.col("tp") + F.col("train_neg") - F.col("fp")) / (F.col("train_pos") + F.col("train_neg")))
        .withColumn("far", F.try_divide("fp", "train_neg"))
        .withColumn("tar", F.try_divide("tp", "train_pos"))
        .withColumn(
            "test_accuracy",
            (F.col("acc_pos") + F.col("fold_neg") - F.col("acc_neg")) / (F.col("fold_pos") + F.col("fold_neg")),
        )
        .withColumn("test_tar", F.coalesce(F.try_divide("acc_pos", "fold_pos"), F.lit(0.0)))
        .withColumn("test_far", F.try_divide("acc_neg", "fold_neg"))
    )


def kfold_verification(pairs: DataFrame, folds: int = 10) -> tuple[DataFrame, DataFrame]:
    """Per-fold rows and their summary.

    ``pairs`` is ``(pair_id, score, status, label)`` with ``pair_id`` counting
    from 1 over all pairs. The fold follows from the position before failed
    pairs are dropped. Thresholds are chosen on the other folds over a fixed
    grid, so everything after the first aggregation has at most
    ``folds * grid`` rows.
    """
    points = fold_points(fold_histogram(pairs, folds))

    def tar_pick(target: float) -> Column:
        usable = F.col("far") <= target
        return F.min(F.when(usable, F.struct(-F.coalesce("tar", F.lit(-1.0)), "threshold", "test_tar")))["test_tar"]

    per_fold = points.groupBy("fold").agg(
        F.min(F.struct(-F.col("accuracy"), "threshold", "test_accuracy")).alias("best"),
        *[F.coalesce(tar_pick(t), F.lit(0.0)).alias(fold_tar_name(t)) for t in FOLD_TARGET_FARS],
    )
    per_fold = per_fold.select(
        (F.col("fold") + 1).alias("fold"),
        F.col("best.threshold").alias("threshold"),
        F.col("best.test_accuracy").alias("accuracy"),
        *[fold_tar_name(t) for t in FOLD_TARGET_FARS],
    )
    measured = ["accuracy", "threshold", *[fold_tar_name(t) for t in FOLD_TARGET_FARS]]
    summary = per_fold.agg(
        F.count(F.lit(1)).alias("folds"),
        *[
            F.round(function(name), 4).alias(f"{name}_{suffix}")
            for name in measured
            for function, suffix in ((F.avg, "mean"), (F.stddev_pop, "std"))
        ],
    )
    return per_fold, summary


def kfold_targets(pairs: DataFrame, folds: int = 10, targets: Sequence[float] = FOLD_TARGET_FARS) -> DataFrame:
    """Per fold and target: the threshold chosen on the other folds, their rates there, and those of the fold.

    ``(fold, target_far, threshold, train_far, train_frr, test_tar, test_far)``. Of
    the thresholds whose FAR on the other folds is at or below the target the one
    of the highest TAR is taken, the lowest on ties. A target that none meets has
    null rates and a test TAR of 0.
    """
    points = fold_points(fold_histogram(pairs, folds))
    names = ["threshold", "far", (1 - F.col("tar")).alias("frr"), "test_tar", "test_far"]
    picks = [
        F.min(F.when(F.col("far") <= t, F.struct((-F.coalesce("tar", F.lit(-1.0))).alias("_v"), *names))) for t in targets
    ]
    rows = F.array(*[F.struct(F.lit(float(t)).alias("target_far"), p.alias("b")) for t, p in zip(targets, picks)])
    chosen = points.groupBy("fold").agg(rows.alias("rows")).select("fold", F.inline("rows"))
    return chosen.select(
        (F.col("fold") + 1).alias("fold"),
        "target_far",
        "b.threshold",
        F.col("b.far").alias("train_far"),
        F.col("b.frr").alias("train_frr"),
        F.coalesce("b.test_tar", F.lit(0.0)).alias("test_tar"),
        "b.test_far",
    )


def kfold_overall(pairs: DataFrame, folds: int = 10, targets: Sequence[float] = FOLD_TARGET_FARS) -> DataFrame:
    """Metrics of all usable pairs on the same grid, one row per ``metric``.

    ``(metric, value, threshold, far, frr)``: ``accuracy`` at its best threshold,
    ``eer``, and ``tar_at_far_...`` for every target. All come from the histogram
    of the folds. A metric that is undefined has nulls.
    """
    bins = fold_histogram(pairs, folds).groupBy("bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    steps = pairs.sparkSession.range(-1, GRID_STEPS + 1).select(F.col("id").cast("int").alias("bin"), F.lit(0).alias("fold"))
    filled = steps.join(bins, "bin", "left").fillna(0, ["pos", "neg"])
    sums = bins.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("p"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n"))
    counts = _upward(filled, ["fold"]).where("bin >= 0").select(
        grid_threshold(F.col("bin")).alias("threshold"),
        F.col("acc_pos").alias("tp"),
        F.col("acc_neg").alias("fp"),
        (sums.select("n").scalar() - F.col("acc_neg")).alias("tn"),
        (sums.select("p").scalar() - F.col("acc_pos")).alias("fn"),
    )
    curve = durable(counts.withColumns(rate_columns(*[F.col(c) for c in COUNTS])))
    shown = ["threshold", "far", "frr"]
    best = best_accuracy(curve).select(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"), *shown)
    eer = equal_error_rate(curve, strict=False).select(F.lit("eer").alias("metric"), F.col("eer").alias("value"), *shown)
    names = F.create_map(*[x for t in targets for x in (F.lit(float(t)), F.lit(fold_tar_name(t)))])
    tars = tar_at_far(curve, targets).select(names[F.col("target_far")].alias("metric"), F.col("tar").alias("value"), *shown)
    return best.unionByName(eer).unionByName(tars)


def fold_tar_name(target: float) -> str:
    # written out, so that 0.0001 does not become an exponent
    return "tar_at_far_" + f"{target:.4f}".rstrip("0").replace(".", "_")


def _upward(filled: DataFrame, by: list[str]) -> DataFrame:
    """Pairs at or above each grid bin; a group has one row per bin."""
    window = Window.partitionBy(*by).orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return filled.select(*by, "bin", F.sum("pos").over(window).alias("acc_pos"), F.sum("neg").over(window).alias("acc_neg"))


def operating_point(scored: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Counts and rates of the usable pairs at one threshold in a single aggregation."""
    match, same = F.col("score") >= threshold, F.col("label") == 1
    cases = {"tp": match & same, "fp": match & ~same, "tn": ~match & ~same, "fn": ~match & same}
    counts = usable_pairs(scored).groupBy(*by).agg(
        *[F.sum(case.cast("long")).alias(name) for name, case in cases.items()]
    )
    return counts.withColumns(
        {"threshold": F.lit(float(threshold)), **rate_columns(*[F.col(c) for c in COUNTS])}
    )


def fallback_stats(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Totals of images read the normal and the fallback way, and of failures.

    ``rows`` are scored pairs with ``key1`` and ``key2``; ``meta`` is
    ``(key, runtime_images, fallback_images)``. Only ok pairs count images.
    """

    def side(n: int) -> DataFrame:
        return meta.select(
            F.col("key").alias(f"key{n}"),
            F.col("runtime_images").alias(f"_r{n}"),
            F.col("fallback_images").alias(f"_f{n}"),
        )

    joined = rows.join(side(1), "key1", "left").join(side(2), "key2", "left")
    ok = F.col("status") == "ok"
    runtime = F.coalesce("_r1", F.lit(0)) + F.coalesce("_r2", F.lit(0))
    fallback = F.coalesce("_f1", F.lit(0)) + F.coalesce("_f2", F.lit(0))

    def total(value: Column) -> Column:
        return F.sum(value.cast("long"))

    return joined.agg(
        total(F.when(ok, runtime).otherwise(0)).alias("runtime_success_images"),
        total(F.when(ok, fallback).otherwise(0)).alias("fallback_center_crop_images"),
        total(ok & (fallback > 0)).alias("fallback_pairs_count"),
        total(F.col("status") == "no_face").alias("final_no_face"),
        total(F.col("status").isin("face_processing_error", "error")).alias("final_extractor_error"),
    )
