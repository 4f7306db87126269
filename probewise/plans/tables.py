"""Domain tables over the given parquet tables.

The given tables have no gallery, pair or request columns, so these are
derived from the values of every row. ``sql_tables`` states the same tables in
SQL for the independent check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probewise.functions.vectors import doubles

EPOCH = "2024-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def minutes_after_epoch(count: Column) -> Column:
    return F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(mins=count)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, label, v)`` with double vectors."""
    table = read(spark, sf_dir, "embeddings")
    return table.select("vec_id", "label", doubles("embedding").alias("v"))


def space_of(v: str = "v") -> Column:
    return F.when(F.col(v)[0] >= 0, "custom").otherwise("pretrained")


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of the search gallery, one row per vector."""
    return vectors(spark, sf_dir).select(
        F.col("vec_id").alias("id"),
        F.col("label").cast("long").alias("person_id"),
        space_of().alias("pipeline"),
        F.when(F.col("v")[1] >= -0.125, "m_new").otherwise("m_old").alias("model"),
        F.size("v").alias("dim"),
        "v",
        minutes_after_epoch(F.col("vec_id")).alias("created_at"),
        (F.col("v")[2] > -0.1875).alias("is_active"),
    )


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of the search gallery, from the suppliers."""
    return read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.concat(F.lit("Subject_"), F.col("s_nationkey").cast("string")).alias("label"),
        F.when(F.col("s_acctbal") < 1000, "deleted").otherwise("active").alias("status"),
    )


def blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second view of every vector: ``v + w * other``, more or less like it."""
    base = vectors(spark, sf_dir)
    n = base.agg(F.count(F.lit(1))).scalar()
    other = base.select(F.col("vec_id").alias("_o"), F.col("v").alias("_b"))
    weight = 1 + F.col("vec_id") % 5
    mixed = base.withColumn("_o", (F.col("vec_id") * 7 + 3) % n).join(other, "_o")
    return mixed.select("vec_id", "label", F.zip_with("v", "_b", lambda x, y: x + weight * y).alias("v"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query faces: the second views, three to an image."""
    return blends(spark, sf_dir).select(
        F.col("vec_id").alias("probe_id"),
        F.floor(F.col("vec_id") / 3).alias("image_id"),
        (F.col("vec_id") % 3).alias("face_index"),
        "label",
        "v",
    )


def extraction_status(v: str = "v") -> Column:
    value = F.col(v)[3]
    return F.when(value > 0.3125, "no_face").when(value < -0.3125, "face_processing_error").otherwise("ok")


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(key, v, status)``: even keys first views, odd keys second views."""
    found = F.col("v")[4] >= -0.3125
    first = vectors(spark, sf_dir).select((F.col("vec_id") * 2).alias("key"), "v", extraction_status().alias("status"))
    second = blends(spark, sf_dir).select((F.col("vec_id") * 2 + 1).alias("key"), "v", F.lit("ok").alias("status"))
    return first.where(found).unionByName(second)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pairs per vector: its two views, and its first view with another one's."""
    base = vectors(spark, sf_dir)
    n = base.agg(F.count(F.lit(1))).scalar()
    a = F.col("vec_id")
    other = (a + 1 + (a * 13) % (n - 1)) % n
    keyed = base.select("vec_id", space_of().alias("pipeline"))
    same = keyed.select(
        (a * 2 + 1).alias("pair_id"), F.lit(1).alias("label_same"), (a * 2).alias("key1"), (a * 2 + 1).alias("key2"), "pipeline"
    )
    different = keyed.select(
        (a * 2 + 2).alias("pair_id"), F.lit(0).alias("label_same"), (a * 2).alias("key1"), (other * 2).alias("key2"), "pipeline"
    )
    return same.unionByName(different)


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of the table-maintenance queries, from the customers."""
    created = minutes_after_epoch(F.floor(F.col("c_acctbal")))
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.concat("c_mktsegment", F.lit("_"), F.col("c_nationkey").cast("string")).alias("label"),
        F.when(F.col("c_acctbal") < 500, "deleted").otherwise("active").alias("status"),
        created.alias("created_at"),
        created.alias("updated_at"),
    )


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding rows without their vectors, from the orders."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("person_id"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "custom").otherwise("pretrained").alias("pipeline"),
        F.col("o_orderpriority").alias("model"),
        F.lit(512).alias("dim"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderstatus") != "F").alias("is_active"),
    )


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_audit(read(spark, sf_dir, "events"))


def as_audit(events: DataFrame) -> DataFrame:
    """Events, also streamed ones, as audit rows."""
    return events.select(
        "event_id",
        "event_type",
        F.when(F.col("value") >= 100, "admin").otherwise("operator").alias("actor_role"),
        F.concat(F.lit("/v1/"), "event_type").alias("route"),
        F.lit(200).alias("status_code"),
        F.col("props").alias("details"),
        F.col("ts").alias("created_at"),
        F.col("value").alias("latency_ms"),
        "user_id",
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Throttle input: one key per event type and user."""
    return as_requests(read(spark, sf_dir, "events"))


def as_requests(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", F.col("event_type").alias("category"), F.col("user_id").cast("string").alias("identity"), "ts"
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live frames: one session per user."""
    return as_frames(read(spark, sf_dir, "events"))


def as_frames(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("session"),
        "ts",
        F.col("event_id").alias("frame_id"),
        F.when(F.col("value") >= 10, "custom").otherwise("pretrained").alias("pipeline"),
        F.when(F.col("event_type") == "error", "unknown").otherwise("match").alias("decision"),
        F.col("event_type").alias("label"),
        F.least(F.col("value") / 40, F.lit(1.0)).alias("score"),
        F.lit(0.205047).alias("threshold"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes: four to an image, the size and place taken from value and props."""
    k = F.get_json_object("props", "$.k").cast("double")
    x1, y1 = F.col("value") % 40, k % 30
    side = F.round(20 + k, 2)
    return read(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 4).alias("image_id"),
        (F.col("event_id") % 4).alias("face_index"),
        F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.array(x1, y1, x1 + side, y1 + side)).alias("bbox"),
        F.least(F.round(F.col("value") / 100, 4), F.lit(1.0)).alias("det_score"),
        F.when(F.col("event_type") != "signup", 120).alias("width"),
        F.when(F.col("event_type") != "signup", 90).alias("height"),
        F.round(F.col("value") * 2, 2).alias("blur"),
    )
