import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from probewise.operators import verification as ver


def scored(spark, positives, negatives):
    rows = [(float(s), 1) for s in positives] + [(float(s), 0) for s in negatives]
    return spark.createDataFrame(rows, "score double, label int")


def grid(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "position long, threshold double")


def one(df):
    (row,) = df.collect()
    return row


def test_counts_on_a_listed_grid(spark):
    df = scored(spark, [0.88, 0.61, 0.33], [0.52, 0.47, 0.08])
    rows = ver.confusion_curve(df, grid(spark, [0.5, 0.7, 0.1])).orderBy("position").collect()
    assert [(r["tp"], r["fp"], r["tn"], r["fn"]) for r in rows] == [(2, 1, 2, 1), (1, 0, 3, 2), (3, 2, 1, 0)]


def test_null_and_one_class_groups(spark):
    rows = [(None, 0.9, "ok", 1), (None, 0.2, "ok", 0), ("a", 0.8, "ok", 1), ("a", 0.4, "ok", 0)]
    df = spark.createDataFrame(rows, "g string, score double, status string, label int")
    found = {r["g"]: r["best_accuracy"] for r in ver.verification_summary(df, ["g"]).collect()}
    assert found == {None: 1.0, "a": 1.0}


def test_boundary_is_a_match(spark):
    df = scored(spark, [0.5], [0.5])
    row = one(ver.operating_point(df, 0.5))
    assert (row["tp"], row["fp"], row["tn"], row["fn"]) == (1, 1, 0, 0)


def test_default_thresholds_reach_past_both_ends(spark):
    df = scored(spark, [0.9, 0.5], [0.5])
    values = sorted(r[0] for r in ver.default_thresholds(df).collect())
    assert values == [math.nextafter(0.5, -math.inf), 0.5, 0.9, math.nextafter(0.9, math.inf)]


def test_equal_error_rate_at_a_grid_point(spark):
    # at 0.45 one of four on either side is wrong
    df = scored(spark, [0.93, 0.77, 0.58, 0.22], [0.66, 0.41, 0.19, 0.05])
    row = one(ver.equal_error_rate(ver.rate_curve(df, grid(spark, [0.15, 0.45, 0.6]))))
    assert (row["eer"], row["threshold"]) == (0.25, 0.45)


def test_equal_error_rate_between_grid_points(spark):
    # FAR falls from 1/2 to 0 and FRR rises from 1/3 to 2/3 between the two: they meet at 2/5 and 0.6
    df = scored(spark, [0.95, 0.65, 0.31], [0.64, 0.12])
    row = one(ver.equal_error_rate(ver.rate_curve(df, grid(spark, [0.62, 0.72]))))
    assert 0.62 <= row["threshold"] <= 0.72
    assert row["far"] == pytest.approx(row["frr"])
    assert row["eer"] == pytest.approx(0.4)


def test_equal_error_rate_without_a_crossing_takes_the_closest_point(spark):
    df = scored(spark, [0.9, 0.8], [0.7, 0.6])
    row = one(ver.equal_error_rate(ver.rate_curve(df, grid(spark, [0.1, 0.65]))))
    assert (row["threshold"], row["far"], row["frr"]) == (0.65, 0.5, 0.0)


@pytest.mark.parametrize(
    "positives, negatives, eer",
    [([0.9, 0.8], [0.2, 0.1], 0.0), ([0.1, 0.2], [0.8, 0.9], 1.0), ([0.5, 0.5], [0.5, 0.5], 0.5)],
)
def test_perfect_inverted_and_tied_scores(spark, positives, negatives, eer):
    assert one(ver.equal_error_rate(ver.rate_curve(scored(spark, positives, negatives))))["eer"] == pytest.approx(eer)


def test_missing_class_gives_null_rates_and_raises_for_the_error_rate(spark):
    only = ver.rate_curve(scored(spark, [0.9, 0.4], []))
    assert all(r["far"] is None and r["frr"] is not None for r in only.collect())
    with pytest.raises(PySparkException):
        ver.equal_error_rate(only).collect()
    other = ver.rate_curve(scored(spark, [], [0.9, 0.4]))
    assert all(r["tar"] is None and r["far"] is not None for r in other.collect())


def test_tar_at_far(spark):
    curve = ver.rate_curve(scored(spark, [0.95, 0.85, 0.55], [0.90, 0.40, 0.20]))
    rows = {round(r["target_far"], 3): r for r in ver.tar_at_far(curve, [0.0, 1 / 3, 0.2]).collect()}
    assert (rows[0.0]["tar"], rows[0.0]["threshold"]) == (pytest.approx(1 / 3), 0.95)
    assert (rows[0.333]["tar"], rows[0.333]["threshold"]) == (1.0, 0.55)
    assert (rows[0.2]["tar"], rows[0.2]["threshold"]) == (pytest.approx(1 / 3), 0.95)


def test_unreachable_target_is_a_row_of_nulls(spark):
    curve = ver.rate_curve(scored(spark, [0.9], [0.95]), grid(spark, [0.1]))
    row = one(ver.tar_at_far(curve, [0.01]))
    assert row["target_far"] == 0.01 and row["tar"] is None and row["threshold"] is None


def test_best_accuracy_takes_the_first_of_the_list(spark):
    df = scored(spark, [0.9, 0.8], [0.2, 0.1])
    row = one(ver.best_accuracy(ver.rate_curve(df, grid(spark, [0.7, 0.3, 0.5]))))
    assert (row["threshold"], row["accuracy"]) == (0.7, 1.0)
    assert one(ver.best_accuracy(ver.rate_curve(df)))["threshold"] == 0.8


def reference_curve(rows):
    scores = np.array([r[0] for r in rows])
    labels = np.array([r[1] for r in rows])
    thresholds = [math.nextafter(scores.min(), -math.inf), *np.unique(scores), math.nextafter(scores.max(), math.inf)]
    return {
        t: tuple(int(c.sum()) for c in (
            (scores >= t) & (labels == 1), (scores >= t) & (labels == 0),
            (scores < t) & (labels == 0), (scores < t) & (labels == 1)))
        for t in thresholds
    }


@pytest.mark.parametrize("range_rows", [15, 10_000])
def test_curve_in_many_ranges_equals_brute_force(spark, range_rows):
    rnd = random.Random(3)
    rows = {g: [(round(rnd.gauss(0.4 * l, 0.2), 2), l) for l in [0, 1] * 150] for g in "ab"}
    data = [(g, s, l) for g, part in rows.items() for s, l in part]
    df = spark.createDataFrame(data, "g string, score double, label int")
    found = ver.confusion_curve(df, None, ["g"], range_rows).collect()
    for g, part in rows.items():
        assert {r["threshold"]: (r["tp"], r["fp"], r["tn"], r["fn"]) for r in found if r["g"] == g} == reference_curve(part)


def test_listed_grid_per_group(spark):
    data = [("a", 0.9, 1), ("a", 0.1, 0), ("b", 0.4, 1)]
    df = spark.createDataFrame(data, "g string, score double, label int")
    rows = ver.confusion_curve(df, grid(spark, [0.5, 0.2]), ["g"]).collect()
    assert sorted((r["g"], r["position"], r["tp"], r["fp"]) for r in rows) == [("a", 0, 1, 0), ("a", 1, 1, 0), ("b", 0, 0, 0), ("b", 1, 1, 0)]


def test_rates_are_monotone(spark):
    rnd = random.Random(4)
    df = scored(spark, [rnd.gauss(0.4, 0.2) for _ in range(80)], [rnd.gauss(0, 0.2) for _ in range(80)])
    rows = ver.rate_curve(df).orderBy("threshold").collect()
    assert all(a["far"] >= b["far"] and a["frr"] <= b["frr"] for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("points", [5, 11, 1000])
def test_roc_points(spark, points):
    rnd = random.Random(5)
    df = scored(spark, [rnd.random() for _ in range(40)], [rnd.random() for _ in range(40)])
    curve = ver.rate_curve(df)
    values = sorted(r["threshold"] for r in curve.collect())
    wanted = range(len(values)) if len(values) <= points else np.unique(np.linspace(0, len(values) - 1, points, dtype=np.int64))
    found = sorted(r["threshold"] for r in ver.roc_points(curve, points, (), 9).collect())
    assert found == [values[i] for i in wanted]


def test_auc(spark):
    pos, neg = [0.9, 0.5, 0.5], [0.5, 0.1]
    wins = [1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg]
    assert one(ver.roc_auc(scored(spark, pos, neg)))["auc"] == pytest.approx(np.mean(wins))


def test_summary_skips_failed_pairs_and_rounds(spark):
    rows = [(0.9, "ok", 1), (0.8, "ok", 1), (0.1, "ok", 0), (0.2, "ok", 0), (None, "no_face", 1)]
    row = one(ver.verification_summary(spark.createDataFrame(rows, "score double, status string, label int")))
    assert (row["valid_pairs"], row["positive_pairs"], row["negative_pairs"], row["skipped_pairs"]) == (4, 2, 2, 1)
    assert (row["eer"], row["best_accuracy"], row["tar_at_far_0_01"]) == (0.0, 1.0, 1.0)
    assert row["mean_positive_score"] == pytest.approx(0.85)


def test_summary_per_group_equals_the_summary_of_the_group(spark):
    rnd = random.Random(6)
    data = [(g, rnd.gauss(0.3 * l, 0.2), "ok", l) for g in ("x", "y") for l in (0, 1) * 40]
    df = spark.createDataFrame(data, "g string, score double, status string, label int")
    for row in ver.verification_summary(df, ["g"], 25).collect():
        alone = one(ver.verification_summary(df.where(F.col("g") == row["g"])))
        assert {k: v for k, v in row.asDict().items() if k != "g"} == alone.asDict()


def test_cap_keeps_half_of_each_class(spark):
    rows = [(i, int(i <= 6)) for i in range(1, 11)]
    pairs = spark.createDataFrame(rows, "pair_id long, label_same int")
    kept = sorted(tuple(r) for r in ver.cap_pairs(pairs, 5, 3).collect())
    assert kept == [(1, 1), (2, 1), (7, 0), (8, 0), (9, 0)]
    same = pairs.where("label_same = 1")
    assert sorted(r[0] for r in ver.cap_pairs(same, 4).collect()) == [1, 2, 3, 4]
    assert ver.cap_pairs(pairs, 50).count() == 10


def test_kfold_against_a_loop(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(1, 64):
        label = i % 2
        rows.append((i, round(rnd.gauss(0.3 * label, 0.15), 6), "ok" if i % 11 else "no_face", label))
    pairs = spark.createDataFrame(rows, "pair_id long, score double, status string, label int")
    per_fold, summary = ver.kfold_verification(pairs, 5)
    thresholds = (np.arange(4001) - 2000) / 2000
    size = len(rows) // 5
    used = [(min((i - 1) // size, 4), s, l) for i, s, status, l in rows if status == "ok"]
    accuracies = []
    for row in per_fold.orderBy("fold").collect():
        train = [(s, l) for f, s, l in used if f != row["fold"] - 1]
        test = [(s, l) for f, s, l in used if f == row["fold"] - 1]
        acc = [np.mean([(s >= t) == bool(l) for s, l in train]) for t in thresholds]
        best = thresholds[int(np.argmax(acc))]
        assert row["threshold"] == best
        assert row["accuracy"] == pytest.approx(np.mean([(s >= best) == bool(l) for s, l in test]))
        far = np.array([np.mean([s >= t for s, l in train if l == 0]) for t in thresholds])
        tar = np.array([np.mean([s >= t for s, l in train if l == 1]) for t in thresholds])
        ok = np.flatnonzero(far <= 0.1)
        chosen = thresholds[ok[int(np.argmax(tar[ok]))]]
        assert row["tar_at_far_0_1"] == pytest.approx(np.mean([s >= chosen for s, l in test if l == 1]))
        accuracies.append(row["accuracy"])
    total = one(summary)
    assert total["folds"] == 5
    assert total["accuracy_mean"] == pytest.approx(round(np.mean(accuracies), 4))
    assert total["accuracy_std"] == pytest.approx(round(np.std(accuracies), 4))


@pytest.mark.parametrize("score", [-1.0, -0.9995, 0.0, 0.0005, 0.00049999, 0.333, 1.0, -1.2, 1.3])
def test_grid_bin(spark, score):
    thresholds = (np.arange(4001) - 2000) / 2000
    found = spark.range(1).select(ver.grid_bin(F.lit(score))).first()[0]
    assert found == int((thresholds <= score).sum()) - 1


def test_one_rule_for_unusable_pairs(spark):
    rows = [(0.9, 1), (0.2, 0), (float("nan"), 1), (float("inf"), 0), (None, 1), (0.8, 2), (0.7, None)]
    df = spark.createDataFrame(rows, "score double, label int")
    assert tuple(ver.unusable_pairs(df).first()) == (7, 1, 2, 2)
    assert tuple(ver.operating_point(df, 0.5).select(*ver.COUNTS).first()) == (1, 0, 1, 0)
    curve = ver.confusion_curve(df).orderBy("threshold").collect()
    assert [r["threshold"] for r in curve[1:-1]] == [0.2, 0.9] and all(r["tp"] + r["fn"] == 1 for r in curve)
