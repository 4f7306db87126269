"""Subjects and embeddings as parquet tables that are changed in place.

Both tables are partitioned by a hash of the subject, so a change of some
subjects reads and writes their partitions only. Partitions without a row that
really changes are left as they are: a change that is repeated, after a lost
job or by mistake, writes nothing.

New rows of a partition are worked out and saved before it is overwritten, and
Spark replaces partitions when all their files are written. One writer at a
time is assumed, as for any parquet folder.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from probewise.operators.gallery import enroll, newest_per_label
from probewise.session import durable

BUCKETS = 256
SUBJECTS, EMBEDDINGS = "subjects", "embeddings"


def bucket_of(subject: Column, buckets: int) -> Column:
    """The partition of a subject; null is a subject like any other."""
    text = F.coalesce(subject.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % buckets).cast("int")


class GalleryStore:
    """The two tables below ``path``. The number of buckets is fixed when the store is made."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.buckets = int(spark.read.parquet(f"{path}/layout").first()["buckets"])

    @classmethod
    def create(cls, path: str, subjects: DataFrame, embeddings: DataFrame, buckets: int = BUCKETS) -> GalleryStore:
        spark = subjects.sparkSession
        for name, rows, key in ((SUBJECTS, subjects, "id"), (EMBEDDINGS, embeddings, "person_id")):
            dealt = rows.withColumn("bucket", bucket_of(F.col(key), buckets))
            dealt.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/{name}")
            # an empty table has no files that tell its columns
            spark.createDataFrame([], rows.schema).coalesce(1).write.parquet(f"{path}/{name}_columns")
        spark.createDataFrame([(buckets,)], "buckets int").write.parquet(f"{path}/layout")
        return cls(spark, path)

    def stored(self, name: str, buckets: Collection[int] | None = None) -> DataFrame:
        """A table with its ``bucket``, or only the given buckets of it."""
        schema = self.spark.read.parquet(f"{self.path}/{name}_columns").schema
        rows = self.spark.read.schema(schema.add("bucket", T.IntegerType())).parquet(f"{self.path}/{name}")
        return rows if buckets is None else rows.where(F.col("bucket").isin(*buckets))

    @property
    def subjects(self) -> DataFrame:
        return self.stored(SUBJECTS).drop("bucket")

    @property
    def embeddings(self) -> DataFrame:
        return self.stored(EMBEDDINGS).drop("bucket")

    def buckets_of(self, subjects: DataFrame, key: str = "id") -> list[int]:
        """The buckets of some subjects: at most as many numbers as there are partitions."""
        rows = subjects.select(bucket_of(F.col(key), self.buckets).alias("bucket")).distinct().collect()
        return sorted(row["bucket"] for row in rows)

    def update(self, name: str, changes: dict[str, Column], hit: Column, marked: DataFrame) -> list[int]:
        """Set columns where ``hit`` holds; writes, and returns, the buckets with such a row alone."""
        found = durable(marked.withColumn("_hit", F.coalesce(hit, F.lit(False))))
        touched = [row["bucket"] for row in found.where("_hit").select("bucket").distinct().collect()]
        if touched:
            columns = [c for c in self.stored(name).columns]
            new = {c: F.when(F.col("_hit"), value).otherwise(F.col(c)) for c, value in changes.items()}
            self.overwrite(name, found.where(F.col("bucket").isin(*touched)).withColumns(new).select(*columns))
        return sorted(touched)

    def overwrite(self, name: str, rows: DataFrame) -> None:
        """Replace the partitions that ``rows`` has."""
        writer = durable(rows).hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("bucket").parquet(f"{self.path}/{name}")

    def append(self, name: str, key: str, rows: DataFrame) -> list[int]:
        """Add the rows whose ``id`` is not in their partition; returns the partitions that got some."""
        dealt = rows.withColumn("bucket", bucket_of(F.col(key), self.buckets))
        buckets = self.buckets_of(rows, key)
        new = durable(dealt.join(self.stored(name, buckets).select("id", "bucket"), ["id", "bucket"], "left_anti"))
        touched = [row["bucket"] for row in new.select("bucket").distinct().collect()]
        if touched:
            columns = self.stored(name).columns
            new.select(*columns).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/{name}")
        return sorted(touched)

    def marked(self, name: str, key: str, ids: DataFrame, buckets: Collection[int]) -> DataFrame:
        gone = ids.select(F.col("id").alias(key)).distinct().withColumn("_named", F.lit(True))
        return self.stored(name, buckets).join(gone, key, "left")

    def soft_delete(self, ids: DataFrame) -> dict[str, list[int]]:
        """Mark subjects ``ids(id)`` deleted and their embeddings inactive; the buckets written of each table."""
        buckets = self.buckets_of(ids)
        if not buckets:
            return {SUBJECTS: [], EMBEDDINGS: []}
        named = F.col("_named")
        people = self.marked(SUBJECTS, "id", ids, buckets)
        rows = self.marked(EMBEDDINGS, "person_id", ids, buckets)
        return {
            # embeddings first: a job lost in between leaves no row alive of a deleted subject
            EMBEDDINGS: self.update(EMBEDDINGS, {"is_active": F.lit(False)}, named & F.col("is_active"), rows),
            SUBJECTS: self.update(SUBJECTS, {"status": F.lit("deleted")}, named & ~F.col("status").eqNullSafe("deleted"), people),
        }

    def collapse_duplicates(self, keep: str = "newest") -> dict[str, list[int]]:
        """Keep one active subject per label and soft-delete the others."""
        kept = newest_per_label(self.subjects, keep).select("id")
        active = self.subjects.where("status = 'active' AND label IS NOT NULL")
        return self.soft_delete(durable(active.join(kept, "id", "left_anti").select("id")))

    def deactivate(self, persons: DataFrame, pipelines: Collection[str] | None = None) -> list[int]:
        """Switch off the embeddings of ``persons(id)``, optionally of some spaces; the buckets written."""
        buckets = self.buckets_of(persons)
        if not buckets:
            return []
        hit = F.col("_named") & F.col("is_active")
        if pipelines:
            hit = hit & F.col("pipeline").isin(*pipelines)
        rows = self.marked(EMBEDDINGS, "person_id", persons, buckets)
        return self.update(EMBEDDINGS, {"is_active": F.lit(False)}, hit, rows)

    def enroll(self, batch: DataFrame) -> dict[str, list[int]]:
        """Add a batch as ``operators.gallery.enroll`` does; a batch that is repeated adds nothing."""
        people, rows = enroll(self.subjects, self.embeddings.limit(0), batch)
        old = self.subjects.select("id")
        rows, people = durable(rows), durable(people.join(old, "id", "left_anti"))
        seen = self.embeddings.join(rows.select("id"), "id", "left_semi").select("id")
        fresh = durable(rows.join(seen, "id", "left_anti"))
        named = people.join(fresh.select(F.col("person_id").alias("id")), "id", "left_semi")
        return {SUBJECTS: self.append(SUBJECTS, "id", named), EMBEDDINGS: self.append(EMBEDDINGS, "person_id", fresh)}

    def import_rows(self, new: DataFrame, mode: str = "skip") -> dict[str, list[int]]:
        """Add embeddings; the buckets in which rows were ``switched_off`` and ``added``.

        ``skip`` leaves out subjects that have active rows in the space; ``replace``
        switches those off first. Rows whose id is there already are not added again.
        """
        space = ["person_id", "pipeline", "model"]
        buckets = self.buckets_of(new, "person_id")
        if not buckets:
            return {"switched_off": [], "added": []}
        there = self.stored(EMBEDDINGS, buckets)
        if mode == "skip":
            active = there.where("is_active").select(*space).distinct()
            return {"switched_off": [], "added": self.append(EMBEDDINGS, "person_id", new.join(active, space, "left_anti"))}
        own = new.select("id").distinct().withColumn("_own", F.lit(True))
        named = new.select(*space).distinct().withColumn("_named", F.lit(True))
        marked = there.join(named, space, "left").join(own, "id", "left")
        hit = F.col("_named") & F.col("is_active") & F.col("_own").isNull()
        off = self.update(EMBEDDINGS, {"is_active": F.lit(False)}, hit, marked)
        return {"switched_off": off, "added": self.append(EMBEDDINGS, "person_id", new)}


def open_or_create(path: str, subjects: DataFrame, embeddings: DataFrame, buckets: int = BUCKETS) -> GalleryStore:
    """The store at ``path``, made of the given tables where there is none."""
    try:
        return GalleryStore(subjects.sparkSession, path)
    except AnalysisException:
        return GalleryStore.create(path, subjects, embeddings, buckets)
