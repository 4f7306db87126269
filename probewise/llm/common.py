"""What several operators share: registration, word splitting, hashed order."""

from __future__ import annotations

import gc
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probewise.session import durable

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SPACES = "\x20\t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HASH_SPACE = 1 << 32
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000
#: Rows of a broadcast table of keys and hashes at most, 16 to 40 bytes each; beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000
#: Rows of a partition of a saved table of keys, about, and the tasks that count them at most.
SAVED_ROWS, COUNT_TASKS = 20_000, 32
#: Rows that a bucket of the hashed order holds at most, about.
BUCKET_ROWS = 50_000


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def small_batches(spark: SparkSession) -> None:
    """Hand long texts to Python workers some at a time, unless the session says otherwise."""
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(keys: DataFrame) -> DataFrame:
    """A table of keys, cheap to count, to be broadcast if it is small."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def saved(df: DataFrame, rows: int = SAVED_ROWS) -> DataFrame:
    """``durable``, read in as many partitions as its rows ask for.

    Partitions of a few rows would make as many tasks, shuffle files and
    checkpoint files in every step that reads them.
    """
    out = durable(df)
    return out.coalesce(max(1, -(-out.coalesce(COUNT_TASKS).count() // rows)))


def let_go(spark: SparkSession) -> None:
    """Have the driver collect what nothing refers to any more; Spark then removes its shuffle files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def mixed_order(*columns: Column) -> Column:
    """A number below ``HASH_SPACE`` that spreads rows evenly and stays the same in reruns."""
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def buckets_for(spark: SparkSession, rows: int) -> int:
    """Buckets of the hashed order: tasks' worth of rows each, however many rows there are."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))


def running_total(df: DataFrame, by: Sequence[str], order: str, ties: Sequence[str], value: str, out: str, rows: int) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the earlier rows of the same group.

    ``order`` is a column of ``mixed_order``, ``ties`` order equal ones, and
    ``by`` must not be null. A group is cut along its hashed order, which is
    even by itself, into buckets that are summed on their own, so a group that
    holds a third of all rows is many windows. ``df`` is read twice.
    """
    n = buckets_for(df.sparkSession, rows)
    cut = df.withColumn("_bucket", F.floor(F.col(order) * F.lit(n) / F.lit(HASH_SPACE)).cast("long"))
    before = (Window.unboundedPreceding, -1)
    window = Window.partitionBy(*by, "_bucket").orderBy(order, *ties).rowsBetween(*before)
    within = cut.withColumn("_within", F.coalesce(F.sum(value).over(window), F.lit(0)))
    sums = cut.groupBy(*by, "_bucket").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(*before)
    starts = sums.select(*by, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    joined = within.join(starts, [*by, "_bucket"])
    return joined.select(*df.columns, (F.col("_start") + F.col("_within")).alias(out))
