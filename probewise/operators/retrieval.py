"""Retrieval and identification metrics, latency summaries, leaderboards."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probewise.operators.ordered import RANGE_ROWS, exact_quantiles, join_on, row_numbers

# fixed values: cut-offs of the overlap report, targets of a strong model
OVERLAP_KS = (1, 5, 10)
TARGET_ACCURACY, TARGET_EER, TARGET_TAR = 0.95, 0.07, 0.80
LATENCY_FRACTIONS = (0.5, 0.95, 0.99)


def topk_overlap(exact: DataFrame, approx: DataFrame, ks: Sequence[int] = OVERLAP_KS, by: Sequence[str] = ()) -> DataFrame:
    """Mean share of the exact top-k found by the other search, per ``k``.

    Both sides are ``(by…, probe_id, id, rank)``; every probe of the exact side
    counts, found or not.
    """
    by = list(by)
    other = approx.select(*by, "probe_id", "id", F.col("rank").alias("_other"))
    keys = [*by, "probe_id", "id"]
    joined = exact.select(*by, "probe_id", "id", "rank").join(other, keys, "left")
    hits = [
        F.sum(((F.col("rank") <= k) & F.coalesce(F.col("_other") <= k, F.lit(False))).cast("long")).alias(f"h{k}")
        for k in ks
    ]
    totals = joined.groupBy(*by).agg(F.count_distinct("probe_id").alias("_q"), *hits)
    rows = F.array(
        *[F.struct(F.lit(k).alias("k"), F.round(F.col(f"h{k}") / k / F.col("_q"), 6).alias("overlap")) for k in ks]
    )
    return totals.select(*by, F.inline(rows))


def recall_at_k(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Share of sampled queries with the true label among the first ``k``.

    Queries without results stay in the denominator.
    """
    found = results.where(F.col("rank") <= k).select("probe_id", "label").distinct()
    wanted = truth.select("probe_id", F.col("label").alias("true_label"))
    hits = wanted.join(
        found.withColumnRenamed("label", "true_label").withColumn("_hit", F.lit(1)), ["probe_id", "true_label"], "left"
    )
    return hits.agg(
        F.count(F.lit(1)).alias("queries"),
        F.sum(F.coalesce("_hit", F.lit(0))).alias("found"),
        F.round(F.avg(F.coalesce("_hit", F.lit(0))), 6).alias("recall"),
    )


def classify_outcomes(responses: DataFrame) -> DataFrame:
    """Add ``outcome`` to ``(expected, predicted, decision, status_code)`` rows."""
    no_match = (F.col("decision") != "match") | F.col("decision").isNull() | (F.coalesce("predicted", F.lit("")) == "")
    outcome = (
        F.when(F.col("status_code").isNull() | (F.col("status_code") != 200), "error")
        .when(no_match, "no_match")
        .when(F.col("predicted") == F.col("expected"), "correct")
        .otherwise("false_match")
    )
    return responses.withColumn("outcome", outcome)


def identification_report(outcomes: DataFrame) -> DataFrame:
    """Counts and rates per expected label, and the total in the row with a null label."""

    def count(name: str) -> Column:
        return F.sum((F.col("outcome") == name).cast("long"))

    counted = outcomes.rollup("expected").agg(
        F.grouping("expected").alias("is_total"),
        F.count(F.lit(1)).alias("items"),
        count("correct").alias("correct"),
        count("false_match").alias("false_match"),
        count("no_match").alias("no_match"),
        count("error").alias("errors"),
    )
    return counted.withColumns(
        {
            "accuracy": F.round(F.col("correct") / F.col("items"), 6),
            "false_match_rate": F.round(F.col("false_match") / F.col("items"), 6),
            "no_match_rate": F.round(F.col("no_match") / F.col("items"), 6),
        }
    )


def latency_summary(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    method: str = "linear",
    digits: int = 6,
    elapsed: float | None = None,
    accuracy: int | None = None,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Mean and percentiles of a latency column, and queries per second.

    Exact percentiles come from ranks over the whole table; ``accuracy`` asks
    for Spark's sketch instead.
    """
    by = list(by)
    names = ["p" + f"{q * 100:g}" for q in LATENCY_FRACTIONS]
    stats = [F.count(value).alias("n"), F.round(F.avg(value), digits).alias("mean")]
    if accuracy is not None:
        sketch = F.percentile_approx(value, list(LATENCY_FRACTIONS), accuracy)
        stats += [F.round(sketch[i], digits).alias(name) for i, name in enumerate(names)]
        result = df.groupBy(*by).agg(*stats)
    else:
        keyed = by or ["_g"]
        source = df if by else df.withColumn("_g", F.lit(0))
        points = exact_quantiles(source, value, LATENCY_FRACTIONS, keyed, method, range_rows)
        wide = points.groupBy(*keyed).agg(
            *[
                F.round(F.max(F.when(F.col("fraction") == q, F.col(value))), digits).alias(name)
                for q, name in zip(LATENCY_FRACTIONS, names)
            ]
        )
        result = join_on(source.groupBy(*keyed).agg(*stats), wide, keyed)
        result = result if by else result.drop("_g")
    if elapsed is not None:
        result = result.withColumn("qps", F.col("n") / F.lit(float(elapsed)))
    return result


def sample_queries(df: DataFrame, n: int, seed: int, key: str = "id", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``min(n, rows)`` distinct rows, the same ones for the same seed.

    The order is that of a digest of seed and key, so any engine can repeat it.
    """
    hashed = df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))))
    numbered = row_numbers(hashed.select("_h", key), [("_h", True), (key, True)], (), "_n", range_rows)
    chosen = numbered.where(F.col("_n") <= n).select(key)
    return df.join(chosen, key, "left_semi")


def self_match(gallery: DataFrame, n: int | None, k: int, search: Callable[[DataFrame, DataFrame, int], DataFrame], identities: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Search the gallery for its own first ``n`` rows; attach both identities.

    ``identities`` is ``(id, identity)``; ``search(probes, gallery, k)`` is any
    top-k search.
    """
    probes = gallery.select(F.col("id").alias("probe_id"), "v")
    if n is not None:
        first = row_numbers(gallery.select("id"), [("id", True)], (), "_n", range_rows).where(F.col("_n") <= n)
        probes = probes.join(first.select(F.col("id").alias("probe_id")), "probe_id", "left_semi")
    found = search(probes, gallery, k)
    named = found.join(identities, "id", "left")
    own = identities.select(F.col("id").alias("probe_id"), F.col("identity").alias("probe_identity"))
    return named.join(own, "probe_id", "left")


def benchmark_grid(
    exact: DataFrame,
    configs: Mapping[str, Callable[[], DataFrame]],
    ks: Sequence[int] = OVERLAP_KS,
    notes: Mapping[str, str] | None = None,
) -> DataFrame:
    """Overlap of every configuration with the exact result.

    A configuration that cannot be built stays in the table with its error;
    ``notes`` are remarks by configuration, such as a thin training set.
    """
    notes = notes or {}
    found, states = None, []
    for name, run in configs.items():
        try:
            result = run().select(F.lit(name).alias("config"), "probe_id", "id", "rank")
            found = result if found is None else found.unionByName(result)
            states.append((name, "ok", "", notes.get(name, "")))
        except ValueError as problem:
            states.append((name, "failed", str(problem), notes.get(name, "")))
    status = exact.sparkSession.createDataFrame(states, "config string, status string, error string, notes string")
    rows = status.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks])))
    if found is None:
        return rows.withColumn("overlap", F.lit(None).cast("double"))
    built = [F.lit(name) for name, state, *_ in states if state == "ok"]
    truth = exact.withColumn("config", F.explode(F.array(*built)))
    return rows.join(topk_overlap(truth, found, ks, ["config"]), ["config", "k"], "left")


# criterion -> (column, larger is better, value for null)
CRITERIA = {
    "lowest_eer": ("eer", False, None),
    "highest_tar": ("tar", True, -1.0),
    "highest_accuracy": ("accuracy", True, None),
}


def leaderboard(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Best run per criterion ``(by…, criterion, run, value)``; the earlier run wins ties."""
    by = list(by)

    def pick(column: str, larger: bool, missing: float | None) -> Column:
        value = F.col(column) if missing is None else F.coalesce(column, F.lit(missing))
        key = -value if larger else value
        return F.min(F.when(value.isNotNull(), F.struct(key.alias("_k"), "run_order", "run", value.alias("value"))))

    picks = [F.struct(F.lit(name).alias("criterion"), pick(*rule).alias("b")) for name, rule in CRITERIA.items()]
    rows = metrics.groupBy(*by).agg(F.array(*picks).alias("rows")).select(*by, F.inline("rows"))
    return rows.select(*by, "criterion", "b.run", "b.value")


def verdict(a: Column, b: Column) -> Column:
    return F.when(a < b, "lower").when(a > b, "higher").when(a == b, "same")


def compare_metrics(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Two metric tables side by side with the verdict of ``a`` against ``b``."""
    measured = ["eer", "accuracy"]
    left = a.select(*key, *[F.col(m).alias(f"{m}_a") for m in measured])
    right = b.select(*key, *[F.col(m).alias(f"{m}_b") for m in measured])
    return left.join(right, list(key)).withColumns(
        {f"{m}_verdict": verdict(F.col(f"{m}_a"), F.col(f"{m}_b")) for m in measured}
    )


def target_check(metrics: DataFrame) -> DataFrame:
    """Flags for accuracy, EER and TAR targets; any one makes a strong candidate."""
    flags = {
        "accuracy_met": F.coalesce(F.col("accuracy") >= TARGET_ACCURACY, F.lit(False)),
        "eer_met": F.coalesce(F.col("eer") <= TARGET_EER, F.lit(False)),
        "tar_met": F.coalesce(F.col("tar") >= TARGET_TAR, F.lit(False)),
    }
    flagged = metrics.withColumns(flags)
    return flagged.withColumn("strong_candidate", F.col("accuracy_met") | F.col("eer_met") | F.col("tar_met"))
