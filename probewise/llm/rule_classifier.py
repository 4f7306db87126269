"""Quality classifier: a sparse ensemble of rules over document statistics.

Shallow trees are grown on the statistics of labelled documents. Every path
from a root is a rule, a conjunction of thresholds; a lasso logistic regression
over the rules keeps a few with weights. The result is compiled into one Spark
column expression over the statistics, so scoring needs no model at run time.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probewise.llm.common import HASH_SPACE, mixed_order, query, read
from probewise.session import durable

STATISTICS = (
    "words",
    "word_length",
    "upper",
    "digits",
    "symbols",
    "points",
    "marks",
    "bars",
    "distinct",
    "repeats",
    "top_word",
)
#: Labelled rows that the model is fitted on at most, taken in a hashed order.
LEARN_ROWS = 200_000
TREES, DEPTH, PENALTY, SEED = 16, 3, 0.0005, 7
ACCEPT = 0.7

Condition = tuple[int, bool, float]  # statistic, at most (else above), threshold


def byte_table() -> np.ndarray:
    """Byte value to its class: capital, digit, symbol, point, mark or bar."""
    table = np.full(256, 6, np.int64)
    for number, group in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^_~=+\\/{}[]", b".,;:?'\"-()", b"!", b"|")):
        table[list(group)] = number
    return table


def statistics_of(text: str, table: np.ndarray) -> tuple[float, ...]:
    words = text.split()
    if not words:
        return (0.0,) * len(STATISTICS)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(table[data], minlength=7)
    n = len(words)
    counts: dict[str, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    repeats = sum(map(eq, words, words[1:]))
    # shares of characters for letters and digits, per word for the rest
    shares = (kinds[0] / len(data), kinds[1] / len(data), *(kinds[i] / n for i in (2, 3, 4, 5)))
    # the share of distinct words falls with length by itself, so it is taken against the root
    return (
        float(n),
        len(data) / n,
        *map(float, shares),
        len(counts) / n**0.75,
        repeats / n,
        max(counts.values()) / n,
    )


def statistics():
    """A column function: text to the struct of its ``STATISTICS``; an empty text is all zeros."""

    @F.pandas_udf(", ".join(f"{name} double" for name in STATISTICS))
    def of(texts: pd.Series) -> pd.DataFrame:
        table = byte_table()
        return pd.DataFrame([statistics_of(t, table) for t in texts], columns=list(STATISTICS), dtype=float)

    return of


def with_statistics(docs: DataFrame, text: str = "text", name: str = "_stats") -> DataFrame:
    return docs.withColumn(name, statistics()(F.coalesce(F.col(text), F.lit(""))))


def paths(node, path: tuple[Condition, ...] = ()) -> list[tuple[Condition, ...]]:
    """Every path that leaves the root of a fitted tree."""
    out = [path] if path else []
    if "Internal" in node.getClass().getSimpleName():
        split = node.split()
        for child, low in ((node.leftChild(), True), (node.rightChild(), False)):
            out += paths(child, (*path, (split.featureIndex(), low, split.threshold())))
    return out


def compiled(rule: tuple[Condition, ...], stats: str) -> Column:
    result = F.lit(True)
    for number, low, threshold in rule:
        value = F.col(f"{stats}.{STATISTICS[number]}")
        result = result & ((value <= threshold) if low else (value > threshold))
    return result


@dataclass(frozen=True)
class RuleModel:
    """Rules with weights and an intercept of the log-odds."""

    rules: tuple[tuple[tuple[Condition, ...], float], ...]
    intercept: float

    def score(self, stats: str = "_stats") -> Column:
        """The probability of label 1 as a column over the statistics."""
        odds = F.lit(self.intercept)
        for rule, weight in self.rules:
            odds = odds + F.when(compiled(rule, stats), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def fit_rules(
    labelled: DataFrame,
    label: str = "label",
    stats: str = "_stats",
    trees: int = TREES,
    depth: int = DEPTH,
    penalty: float = PENALTY,
    seed: int = SEED,
) -> RuleModel:
    """A rule model from rows of statistics and a 0/1 label; rows with a null label are left out.

    Without labels every score is 0.5; with one class only it is that class's
    smoothed share.
    """
    values = F.array(*[F.col(f"{stats}.{name}") for name in STATISTICS])
    known = labelled.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), F.col(stats).alias("_stats"), array_to_vector(values).alias("x"))
    rows, ones = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if ones in (0, rows):
        share = (ones + 1) / (rows + 2)
        return RuleModel((), float(np.log(share / (1 - share))))
    forest = RandomForestClassifier(
        labelCol="y", featuresCol="x", numTrees=trees, maxDepth=depth, minInstancesPerNode=max(2, int(rows // 2000)), subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=seed
    ).fit(known)
    found = {rule: None for tree in forest.trees for rule in paths(tree._java_obj.rootNode())}
    rules = list(found)
    ruled = known.select("y", array_to_vector(F.array(*[compiled(rule, "_stats").cast("double") for rule in rules])).alias("r"))
    # the weights of rules must compare, so rules are not scaled
    lasso = LogisticRegression(labelCol="y", featuresCol="r", regParam=penalty, elasticNetParam=1.0, standardization=False, maxIter=60).fit(ruled)
    weights = lasso.coefficients.toArray()
    return RuleModel(tuple((rule, float(w)) for rule, w in zip(rules, weights) if w != 0.0), float(lasso.intercept))


def held_out(key: Column) -> Column:
    """The test fold: rows that no model may learn from."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def learn(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", learn_rows: int = LEARN_ROWS) -> RuleModel:
    """A model of ``label`` from the labelled rows outside the test fold, at most ``learn_rows`` of them, about."""
    given = labels.where(~held_out(F.col(key))).select(F.col(key).alias("_k"), F.col(label).cast("double").alias("label"))
    labelled = stats.join(given, F.col(key) == F.col("_k")).select("_k", "label", "_stats")
    rows = given.count()
    if rows > learn_rows:
        labelled = labelled.where(mixed_order(F.col("_k")) < int(HASH_SPACE * learn_rows / rows))
    return fit_rules(durable(labelled.drop("_k")))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, score, predicted`` for every row.

    Null texts count as empty; their statistics are all zero and they get a
    score like any other. Rows with a null key are scored and never learned
    from. Labels without a document are ignored, repeated ones count each time.
    """
    stats = durable(with_statistics(docs.select(key, text), text).select(key, "_stats"))
    score = learn(stats, labels, key).score()
    return stats.select(F.col(key), held_out(F.col(key)).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns."""
    stats = durable(with_statistics(docs.select(key, text), text).select(key, "_stats"))
    score = learn(stats, labels, key).score()
    return with_statistics(docs, text).where(score >= ACCEPT).select(*docs.columns)


@query("op10_quality_classifier")
def op10_quality_classifier(spark, sf_dir):
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
