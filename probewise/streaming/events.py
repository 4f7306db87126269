"""Audit rows and request classes, in batch and as streams."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from probewise.functions.vectors import as_column
from probewise.session import durable

# fixed values: retention, request limits per minute, route prefix
RETENTION_DAYS = 30
LIMITS = {"search": 60, "enroll": 20, "admin": 10}
ROUTE_PREFIX = "/v1"
AUDIT_COLUMNS = ("event_type", "actor_role", "route", "status_code", "details", "created_at")


def append_audit(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of audit rows to parquet, all that is there now."""
    return (
        events.select(*AUDIT_COLUMNS)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def prune_audit(audit: DataFrame, now: datetime | Column, days: int = RETENTION_DAYS) -> tuple[DataFrame, DataFrame]:
    """Rows not older than the retention, and the number removed."""
    now = now if isinstance(now, Column) else F.lit(now)
    old = F.col("created_at") < now - F.make_interval(days=F.lit(days))
    return audit.where(~old), audit.agg(F.coalesce(F.sum(old.cast("long")), F.lit(0)).alias("removed"))


def append_audit_by_day(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of audit rows to parquet with a partition per day and batch.

    A batch that is written again after a lost job replaces its own partitions.
    """

    def write(rows: DataFrame, batch: int) -> None:
        dealt = rows.withColumns({"day": F.to_date("created_at"), "batch": F.lit(batch)})
        writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("day", "batch").parquet(path)

    stream = events.select(*AUDIT_COLUMNS).writeStream.foreachBatch(write)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """A log stored by day, with ``day`` and ``batch``; both prune partitions."""
    return spark.read.parquet(path)


@dataclass(frozen=True)
class Pruned:
    """What a retention run did: rows removed, partitions dropped whole and partitions written again."""

    removed: int
    dropped: list[str]
    rewritten: list[str]


def prune_audit_by_day(spark: SparkSession, path: str, now: datetime, days: int = RETENTION_DAYS) -> Pruned:
    """Remove the rows of a log stored by day that are older than the retention.

    Days before the boundary are dropped as folders; only the time of their rows
    is read. Of the boundary day the partitions that hold
    older rows are written again with the others; all later days stay as they
    are. A run that is repeated finds nothing to do.
    """
    cutoff = now - timedelta(days=days)
    rows = read_audit(spark, path).where(F.col("day") <= F.lit(cutoff.date()))
    old = F.col("created_at") < F.lit(cutoff)
    # one row per partition up to the boundary
    found = rows.groupBy("day", "batch").agg(F.count(F.lit(1)).alias("rows"), F.count_if(old).alias("old")).where("old > 0").collect()
    whole = [r for r in found if r["old"] == r["rows"]]
    part = [r for r in found if r["old"] < r["rows"]]
    if part:
        batches = [r["batch"] for r in part]
        kept = durable(rows.where((F.col("day") == F.lit(cutoff.date())) & F.col("batch").isin(*batches) & ~old))
        writer = kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("day", "batch").parquet(path)
    folders = [f"day={r['day']}/batch={r['batch']}" for r in whole]
    for folder in folders:
        drop_folder(spark, f"{path}/{folder}")
    return Pruned(sum(r["old"] for r in found), sorted(folders), sorted(f"day={r['day']}/batch={r['batch']}" for r in part))


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of whatever file system it is in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def route_category(method: Column | str, path: Column | str, prefix: str = ROUTE_PREFIX) -> Column:
    """search, enroll, admin, or null for a request without a limit."""
    prefix = prefix.rstrip("/")
    method = F.upper(as_column(method))
    path = F.regexp_replace(as_column(path), "/+$", "")
    return (
        F.when((method == "POST") & (path == f"{prefix}/search"), "search")
        .when((method == "POST") & (path == f"{prefix}/enroll"), "enroll")
        .when((method == "POST") & (path == f"{prefix}/index/rebuild"), "admin")
        .when((method == "DELETE") & path.startswith(f"{prefix}/persons/"), "admin")
    )


def caller_identity(requests: DataFrame, known_hashes: DataFrame) -> DataFrame:
    """Replace ``api_key`` by ``caller``: the hash of a known key, else the host.

    ``known_hashes`` is ``(key_hash)``; raw keys never leave this operator.
    """
    hashed = requests.withColumn("key_hash", F.sha2(F.coalesce("api_key", F.lit("")), 256))
    known = known_hashes.select("key_hash").distinct().withColumn("_known", F.lit(True))
    host = F.when(F.coalesce("host", F.lit("")) != "", F.col("host")).otherwise("unknown")
    caller = F.when(F.col("_known"), F.concat(F.lit("api:"), F.col("key_hash"))).otherwise(F.concat(F.lit("ip:"), host))
    return hashed.join(known, "key_hash", "left").withColumn("caller", caller).drop("key_hash", "_known", "api_key")


def activity_counts(
    events: DataFrame, window: str = "1 hour", watermark: str = "10 minutes", by: Sequence[str] = ("event_type", "actor_role")
) -> DataFrame:
    """Events per tumbling window; rows later than the watermark are dropped in a stream."""
    source = events
    if events.isStreaming:
        stamped = events.withColumn("created_at", F.col("created_at").cast("timestamp"))
        source = stamped.withWatermark("created_at", watermark)
    counted = source.groupBy(F.window("created_at", window).alias("w"), *by).agg(F.count(F.lit(1)).alias("events"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "events")
