"""Registered queries over scored verification pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probewise.operators import similarity as sim
from probewise.operators import verification as ver
from probewise.plans import sql_tables, tables
from probewise.plans.registry import query
from probewise.plans.sql_tables import with_tables


def pair_rows(spark, sf_dir) -> DataFrame:
    scored = sim.score_pairs(tables.pairs(spark, sf_dir), tables.views(spark, sf_dir))
    return scored.withColumn("label", F.col("label_same"))


def scored(spark, sf_dir) -> DataFrame:
    return pair_rows(spark, sf_dir).where("status = 'ok'").select("pair_id", "pipeline", "score", "label")


def curve(spark, sf_dir) -> DataFrame:
    return ver.rate_curve(scored(spark, sf_dir))


def six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


# a coarse grid of thresholds in an order of its own
LIST_GRID = {
    "list_grid": """SELECT position, (50 - (position * 37) % 101)::DOUBLE / 50 AS threshold
                    FROM (SELECT unnest(range(0, 101)) AS position)""",
    "list_counts": """
        SELECT position, threshold,
               count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp,
               count(*) FILTER (WHERE score >= threshold AND label = 0) AS fp,
               count(*) FILTER (WHERE score < threshold AND label = 0) AS tn,
               count(*) FILTER (WHERE score < threshold AND label = 1) AS fn
        FROM list_grid CROSS JOIN scored GROUP BY ALL""",
}


def list_grid(spark) -> DataFrame:
    position = F.col("id").alias("position")
    return spark.range(101).select(position, ((50 - (F.col("id") * 37) % 101) / 50).alias("threshold"))


@query("a1_default_thresholds", "SELECT threshold FROM grid")
def a1(spark, sf_dir):
    return ver.default_thresholds(scored(spark, sf_dir))


@query("a2_confusion_curve", "SELECT * FROM counts")
def a2(spark, sf_dir):
    return ver.confusion_curve(scored(spark, sf_dir))


@query("a2_confusion_curve_listed", "SELECT * FROM list_counts", extra=LIST_GRID)
def a2_listed(spark, sf_dir):
    return ver.confusion_curve(scored(spark, sf_dir), list_grid(spark))


@query(
    "a3_rate_curve",
    """SELECT threshold, tp, fp, tn, fn, round(far, 6) AS far, round(frr, 6) AS frr, round(tar, 6) AS tar,
              round(accuracy, 6) AS accuracy FROM curve""",
)
def a3(spark, sf_dir):
    return six(curve(spark, sf_dir), *ver.RATES)


@query(
    "a4_best_accuracy",
    """SELECT threshold, round(accuracy, 6) AS accuracy, tp, fp, tn, fn, round(far, 6) AS far, round(frr, 6) AS frr
       FROM curve ORDER BY accuracy DESC, threshold LIMIT 1""",
)
def a4(spark, sf_dir):
    return six(ver.best_accuracy(curve(spark, sf_dir)), "accuracy", "far", "frr")


@query(
    "a4_best_accuracy_listed",
    """SELECT threshold, tp, fp, tn, fn FROM list_counts ORDER BY tp + tn DESC, position LIMIT 1""",
    extra=LIST_GRID,
)
def a4_listed(spark, sf_dir):
    best = ver.best_accuracy(ver.rate_curve(scored(spark, sf_dir), list_grid(spark)))
    return best.select("threshold", *ver.COUNTS)


EER = {
    "adjacent": """
        SELECT *, far - frr AS d, lead(far - frr) OVER w AS d2, lead(threshold) OVER w AS t2, lead(far) OVER w AS far2,
               lead(frr) OVER w AS frr2 FROM curve WINDOW w AS (ORDER BY threshold)""",
    "crossing": """
        SELECT *, CASE WHEN d = 0 THEN 0 ELSE -d / (d2 - d) END AS r FROM adjacent
        WHERE d = 0 OR d * d2 < 0 ORDER BY threshold LIMIT 1""",
    "eer_point": """
        SELECT threshold + r * (t2 - threshold) AS threshold, far + r * (far2 - far) AS far, frr + r * (frr2 - frr) AS frr
        FROM crossing""",
}


@query(
    "a5_equal_error_rate",
    """SELECT round((far + frr) / 2, 6) AS eer, round(threshold, 6) AS threshold, round(far, 6) AS far, round(frr, 6) AS frr
       FROM eer_point""",
    extra=EER,
)
def a5(spark, sf_dir):
    return six(ver.equal_error_rate(curve(spark, sf_dir)), "eer", "threshold", "far", "frr")


TARS = {
    "targets": "SELECT unnest([0.1, 0.01, 0.001])::DOUBLE AS target_far",
    "tars": """
        SELECT target_far, tar, threshold, far, frr FROM (
            SELECT *, row_number() OVER (PARTITION BY target_far ORDER BY tar DESC, threshold) AS pick
            FROM targets JOIN curve ON far <= target_far) WHERE pick = 1""",
}


@query(
    "a6_tar_at_far",
    """SELECT target_far, round(tar, 6) AS tar, threshold, round(far, 6) AS far, round(frr, 6) AS frr
       FROM targets LEFT JOIN tars USING (target_far)""",
    extra=TARS,
)
def a6(spark, sf_dir):
    return six(ver.tar_at_far(curve(spark, sf_dir)), "tar", "far", "frr")


@query(
    "a7_roc_points",
    """SELECT threshold, round(far, 6) AS far, round(frr, 6) AS frr, round(tar, 6) AS tar
       FROM (SELECT *, row_number() OVER (ORDER BY threshold) - 1 AS point, count(*) OVER () AS m FROM curve)
       WHERE point IN (SELECT CASE WHEN i = 100 THEN n - 1 ELSE floor(i * ((n - 1) / 100))::BIGINT END
                       FROM (SELECT unnest(range(0, 101)) AS i) CROSS JOIN (SELECT count(*) AS n FROM curve))""",
)
def a7(spark, sf_dir):
    return six(ver.roc_points(curve(spark, sf_dir), 101), "far", "frr", "tar")


@query(
    "a8_roc_auc",
    """SELECT a.pipeline, round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END), 6) AS auc
       FROM scored a JOIN scored b ON a.pipeline = b.pipeline AND a.label = 1 AND b.label = 0 GROUP BY a.pipeline""",
)
def a8(spark, sf_dir):
    return six(ver.roc_auc(scored(spark, sf_dir), ["pipeline"]), "auc")


SUMMARY = """
    SELECT (SELECT count(*) FROM scored) AS valid_pairs,
           (SELECT count(*) FROM scored WHERE label = 1) AS positive_pairs,
           (SELECT count(*) FROM scored WHERE label = 0) AS negative_pairs,
           (SELECT count(*) FROM pair_rows WHERE status <> 'ok') AS skipped_pairs,
           (SELECT round(avg(score), 6) FROM scored WHERE label = 1) AS mean_positive_score,
           (SELECT round(avg(score), 6) FROM scored WHERE label = 0) AS mean_negative_score,
           round((e.far + e.frr) / 2, 6) AS eer, round(e.threshold, 6) AS eer_threshold, round(e.far, 6) AS eer_far,
           round(e.frr, 6) AS eer_frr, round(b.accuracy, 6) AS best_accuracy, round(b.threshold, 6) AS best_accuracy_threshold,
           round(b.far, 6) AS far_at_best_threshold, round(b.frr, 6) AS frr_at_best_threshold,
           (SELECT round(tar, 6) FROM tars WHERE target_far = 0.1) AS tar_at_far_0_1,
           (SELECT round(tar, 6) FROM tars WHERE target_far = 0.01) AS tar_at_far_0_01,
           (SELECT round(tar, 6) FROM tars WHERE target_far = 0.001) AS tar_at_far_0_001
    FROM eer_point e CROSS JOIN (SELECT * FROM curve ORDER BY accuracy DESC, threshold LIMIT 1) b"""


@query("a9_verification_summary", SUMMARY, extra={**EER, **TARS})
def a9(spark, sf_dir):
    return ver.verification_summary(pair_rows(spark, sf_dir))


def space_summary(space: str) -> str:
    """The summary over the pairs of one space."""
    own = {
        "all_rows": sql_tables.TABLES["pair_rows"],
        "pair_rows": f"SELECT * FROM all_rows WHERE pipeline = '{space}'",
    }
    return f"SELECT '{space}' AS pipeline, * FROM ({with_tables(SUMMARY, {**EER, **TARS, **own})})"


@query("a9_verification_summary_by_space", " UNION ALL ".join(map(space_summary, ("custom", "pretrained"))), embed=False)
def a9_by_space(spark, sf_dir):
    return ver.verification_summary(pair_rows(spark, sf_dir), ["pipeline"])


@query(
    "a10_cap_pairs",
    """SELECT pair_id, label_same FROM (
           SELECT *, row_number() OVER (PARTITION BY label_same ORDER BY pair_id) AS place FROM pairs)
       WHERE place <= CASE WHEN label_same = 1 THEN 150 ELSE 151 END""",
)
def a10(spark, sf_dir):
    return ver.cap_pairs(tables.pairs(spark, sf_dir), 301).select("pair_id", "label_same")


FOLDS = {
    "fold_pairs": """
        SELECT least((pair_id - 1) // greatest(1, (SELECT count(*) FROM pairs) // 10), 9) + 1 AS fold, score, label_same AS label
        FROM pair_rows WHERE status = 'ok'""",
    "fold_grid": "SELECT (unnest(range(0, 4001)) - 2000) / 2000 AS threshold",
    "bin_of": """
        SELECT fold, label, (SELECT count(*) FROM fold_grid g WHERE g.threshold <= s.score) AS reach, count(*) AS c
        FROM fold_pairs s GROUP BY ALL""",
    "steps": "SELECT threshold, row_number() OVER (ORDER BY threshold) AS step FROM fold_grid",
    "fold_counts": """
        SELECT f.fold, s.step, s.threshold,
               coalesce(sum(c) FILTER (WHERE b.fold <> f.fold AND label = 1 AND reach >= step), 0) AS tp,
               coalesce(sum(c) FILTER (WHERE b.fold <> f.fold AND label = 0 AND reach >= step), 0) AS fp,
               sum(c) FILTER (WHERE b.fold <> f.fold AND label = 1) AS pos,
               sum(c) FILTER (WHERE b.fold <> f.fold AND label = 0) AS neg,
               coalesce(sum(c) FILTER (WHERE b.fold = f.fold AND label = 1 AND reach >= step), 0) AS test_tp,
               coalesce(sum(c) FILTER (WHERE b.fold = f.fold AND label = 0 AND reach >= step), 0) AS test_fp,
               sum(c) FILTER (WHERE b.fold = f.fold AND label = 1) AS test_pos,
               sum(c) FILTER (WHERE b.fold = f.fold AND label = 0) AS test_neg
        FROM (SELECT DISTINCT fold FROM fold_pairs) f CROSS JOIN steps s CROSS JOIN bin_of b GROUP BY ALL""",
    "fold_rows": """
        SELECT fold, arg_min(threshold, struct_pack(a := -(tp + neg - fp) / (pos + neg), t := threshold)) AS threshold,
               arg_min((test_tp + test_neg - test_fp) / (test_pos + test_neg),
                       struct_pack(a := -(tp + neg - fp) / (pos + neg), t := threshold)) AS accuracy,
               arg_min(test_tp / test_pos, struct_pack(a := -tp / pos, t := threshold)) FILTER (WHERE fp / neg <= 0.1) AS tar_at_far_0_1,
               arg_min(test_tp / test_pos, struct_pack(a := -tp / pos, t := threshold)) FILTER (WHERE fp / neg <= 0.01) AS tar_at_far_0_01,
               arg_min(test_tp / test_pos, struct_pack(a := -tp / pos, t := threshold)) FILTER (WHERE fp / neg <= 0.001) AS tar_at_far_0_001,
               arg_min(test_tp / test_pos, struct_pack(a := -tp / pos, t := threshold)) FILTER (WHERE fp / neg <= 0.0001) AS tar_at_far_0_0001
        FROM fold_counts GROUP BY fold""",
}
FOLD_COLUMNS = ["accuracy", "threshold", "tar_at_far_0_1", "tar_at_far_0_01", "tar_at_far_0_001", "tar_at_far_0_0001"]


@query(
    "a11_kfold_verification",
    "SELECT fold, " + ", ".join(f"round({c}, 6) AS {c}" for c in FOLD_COLUMNS) + " FROM fold_rows",
    extra=FOLDS,
)
def a11(spark, sf_dir):
    rows, _ = ver.kfold_verification(pair_rows(spark, sf_dir))
    return six(rows, *FOLD_COLUMNS)


@query(
    "a11_kfold_summary",
    "SELECT count(*) AS folds, "
    + ", ".join(f"round(avg({c}), 4) AS {c}_mean, round(stddev_pop({c}), 4) AS {c}_std" for c in FOLD_COLUMNS)
    + " FROM fold_rows",
    extra=FOLDS,
)
def a11_summary(spark, sf_dir):
    return ver.kfold_verification(pair_rows(spark, sf_dir))[1]


@query(
    "a11_kfold_targets",
    """SELECT fold, target_far, round(b.t, 6) AS threshold, round(b.far, 6) AS train_far, round(1 - b.tar, 6) AS train_frr,
              round(coalesce(b.test_tar, 0), 6) AS test_tar, round(b.test_far, 6) AS test_far
       FROM (SELECT fold, target_far, min(struct_pack(v := -tp / pos, t := threshold, far := fp / neg, tar := tp / pos,
                                                      test_tar := test_tp / test_pos, test_far := test_fp / test_neg))
                                      FILTER (WHERE fp / neg <= target_far) AS b
             FROM fold_counts CROSS JOIN (SELECT unnest([0.1, 0.01, 0.001, 0.0001])::DOUBLE AS target_far) GROUP BY ALL)""",
    extra=FOLDS,
)
def a11_targets(spark, sf_dir):
    return six(ver.kfold_targets(pair_rows(spark, sf_dir)), "threshold", "train_far", "train_frr", "test_tar", "test_far")


OVERALL = {
    **FOLDS,
    "all_counts": """
        SELECT s.threshold, coalesce(sum(c) FILTER (WHERE label = 1 AND reach >= step), 0) AS tp,
               coalesce(sum(c) FILTER (WHERE label = 0 AND reach >= step), 0) AS fp,
               sum(c) FILTER (WHERE label = 1) AS pos, sum(c) FILTER (WHERE label = 0) AS neg
        FROM steps s CROSS JOIN bin_of b GROUP BY s.threshold""",
    "all_rates": "SELECT threshold, fp / neg AS far, 1 - tp / pos AS frr, tp / pos AS tar, (tp + neg - fp) / (pos + neg) AS accuracy FROM all_counts",
    "meeting": """
        SELECT min(struct_pack(t := threshold, far, frr)) FILTER (WHERE far = frr) AS z,
               max(struct_pack(t := threshold, far, frr)) FILTER (WHERE far > frr) AS l,
               min(struct_pack(t := threshold, far, frr)) FILTER (WHERE far < frr) AS r
        FROM all_rates""",
    "met": """
        SELECT CASE WHEN z IS NULL THEN l.t + q * (r.t - l.t) ELSE z.t END AS threshold,
               CASE WHEN z IS NULL THEN l.far + q * (r.far - l.far) ELSE z.far END AS far,
               CASE WHEN z IS NULL THEN l.frr + q * (r.frr - l.frr) ELSE z.frr END AS frr
        FROM (SELECT *, (l.far - l.frr) / ((l.far - l.frr) - (r.far - r.frr)) AS q FROM meeting)""",
}


@query(
    "a11_kfold_overall",
    """SELECT metric, round(value, 6) AS value, round(threshold, 6) AS threshold, round(far, 6) AS far, round(frr, 6) AS frr FROM (
           SELECT 'accuracy' AS metric, b.accuracy AS value, b.t AS threshold, b.far, b.frr
           FROM (SELECT min(struct_pack(v := -accuracy, t := threshold, accuracy, far, frr)) AS b FROM all_rates)
           UNION ALL SELECT 'eer', (far + frr) / 2, threshold, far, frr FROM met
           UNION ALL SELECT 'tar_at_far_' || replace(name, '.', '_'), b.tar, b.t, b.far, b.frr
           FROM (SELECT name, min(struct_pack(v := -tar, t := threshold, tar, far, frr)) FILTER (WHERE far <= name::DOUBLE) AS b
                 FROM all_rates CROSS JOIN (SELECT unnest(['0.1', '0.01', '0.001', '0.0001']) AS name) GROUP BY name))""",
    extra=OVERALL,
)
def a11_overall(spark, sf_dir):
    return six(ver.kfold_overall(pair_rows(spark, sf_dir)), "value", "threshold", "far", "frr")


@query(
    "a12_operating_point",
    """SELECT pipeline, 0.205047::DOUBLE AS threshold, tp, fp, tn, fn, round(fp / (fp + tn), 6) AS far,
              round(fn / (tp + fn), 6) AS frr, round(tp / (tp + fn), 6) AS tar, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy
       FROM (SELECT pipeline, count(*) FILTER (WHERE score >= 0.205047 AND label = 1) AS tp,
                    count(*) FILTER (WHERE score >= 0.205047 AND label = 0) AS fp,
                    count(*) FILTER (WHERE score < 0.205047 AND label = 0) AS tn,
                    count(*) FILTER (WHERE score < 0.205047 AND label = 1) AS fn
             FROM scored GROUP BY pipeline)""",
)
def a12(spark, sf_dir):
    return six(ver.operating_point(scored(spark, sf_dir), 0.205047, ["pipeline"]), *ver.RATES)


# some scores are no numbers and some labels neither 0 nor 1
UNCLEAN = {
    "unclean": """
        SELECT pipeline, CASE WHEN key2 % 9 = 0 THEN 'NaN'::DOUBLE WHEN key2 % 9 = 1 THEN 'Infinity'::DOUBLE ELSE score END AS score,
               CASE WHEN key1 % 10 = 0 THEN 2 WHEN key1 % 10 = 2 THEN NULL ELSE label_same END AS label
        FROM pair_rows""",
}


def unclean(spark, sf_dir) -> DataFrame:
    second = F.col("key2") % 9
    score = F.when(second == 0, float("nan")).when(second == 1, float("inf")).otherwise(F.col("score"))
    label = F.when(F.col("key1") % 10 == 0, 2).when(F.col("key1") % 10 != 2, F.col("label"))
    return pair_rows(spark, sf_dir).select("pipeline", score.alias("score"), label.alias("label"))


@query(
    "a2_unusable_pairs",
    """SELECT pipeline, count(*) AS pairs, count(*) FILTER (WHERE score IS NULL) AS unscored,
              count(*) FILTER (WHERE NOT isfinite(score)) AS not_finite,
              count(*) FILTER (WHERE isfinite(score) AND coalesce(label, 2) NOT IN (0, 1)) AS other_label
       FROM unclean GROUP BY pipeline""",
    extra=UNCLEAN,
)
def a2_unusable(spark, sf_dir):
    return ver.unusable_pairs(unclean(spark, sf_dir), ["pipeline"])


@query(
    "a12_operating_point_unclean",
    """SELECT pipeline, count(*) FILTER (WHERE score >= 0.205047 AND label = 1) AS tp,
              count(*) FILTER (WHERE score >= 0.205047 AND label = 0) AS fp,
              count(*) FILTER (WHERE score < 0.205047 AND label = 0) AS tn,
              count(*) FILTER (WHERE score < 0.205047 AND label = 1) AS fn
       FROM unclean WHERE isfinite(score) GROUP BY pipeline""",
    extra=UNCLEAN,
)
def a12_unclean(spark, sf_dir):
    return ver.operating_point(unclean(spark, sf_dir), 0.205047, ["pipeline"]).select("pipeline", *ver.COUNTS)


@query(
    "a13_fallback_stats",
    """SELECT sum(CASE WHEN status = 'ok' THEN a.r + b.r ELSE 0 END)::BIGINT AS runtime_success_images,
              sum(CASE WHEN status = 'ok' THEN a.f + b.f ELSE 0 END)::BIGINT AS fallback_center_crop_images,
              count(*) FILTER (WHERE status = 'ok' AND a.f + b.f > 0) AS fallback_pairs_count,
              count(*) FILTER (WHERE status = 'no_face') AS final_no_face,
              count(*) FILTER (WHERE status IN ('face_processing_error', 'error')) AS final_extractor_error
       FROM pair_rows p LEFT JOIN meta a ON a.key = p.key1 LEFT JOIN meta b ON b.key = p.key2""",
    extra={"meta": "SELECT key, (v[6] >= -0.125)::INT * 2 AS r, (v[6] < -0.125)::INT AS f FROM views"},
)
def a13(spark, sf_dir):
    normal = F.col("v")[5] >= -0.125
    meta = tables.views(spark, sf_dir).select(
        "key", (normal.cast("int") * 2).alias("runtime_images"), (~normal).cast("int").alias("fallback_images")
    )
    return ver.fallback_stats(pair_rows(spark, sf_dir), meta)
