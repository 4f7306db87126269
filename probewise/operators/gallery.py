"""Gallery tables: live rows, counts, paging, soft delete, upsert, import.

Subjects are ``(id, label, status, created_at, updated_at)``; embeddings are
``(id, person_id, pipeline, model, dim, vector, created_at, is_active)``.
Tables are never changed in place: every operator returns the new rows.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probewise.functions.labels import matches_query, strip
from probewise.functions.vectors import is_usable, l2_normalize, uuid5
from probewise.operators.ordered import RANGE_ROWS, row_numbers
from probewise.session import durable

# fixed values: retention and paging defaults
SNAPSHOT_RETENTION = 3
PAGE_SIZE = 200
# most embeddings in one row of the nested view
PROFILE_ROWS = 10_000
# pages that end within this many rows are found as a top-k
SHALLOW_ROWS = 100_000


def live_embeddings(
    embeddings: DataFrame, subjects: DataFrame, pipeline: str | None = None, model: str | None = None
) -> DataFrame:
    """Active embeddings of active subjects, of one space if given."""
    rows = embeddings.where("is_active")
    if pipeline is not None:
        rows = rows.where(F.col("pipeline") == pipeline)
    if model is not None:
        rows = rows.where(F.col("model") == model)
    people = subjects.where("status = 'active'").select(F.col("id").alias("person_id"))
    return rows.join(people, "person_id", "left_semi")


def gallery_stats(embeddings: DataFrame, subjects: DataFrame) -> DataFrame:
    """Live embeddings per space; the row without a space has the totals."""
    live = live_embeddings(embeddings, subjects)
    per_space = live.groupBy("pipeline", "model").agg(F.count(F.lit(1)).alias("embeddings"))
    people = subjects.where("status = 'active'").agg(F.count(F.lit(1)))
    total = per_space.agg(F.coalesce(F.sum("embeddings"), F.lit(0)).alias("embeddings")).select(
        F.lit(None).cast("string").alias("pipeline"),
        F.lit(None).cast("string").alias("model"),
        "embeddings",
        people.scalar().alias("active_persons"),
    )
    return per_space.withColumn("active_persons", F.lit(None).cast("long")).unionByName(total)


def page(
    df: DataFrame,
    limit: int = PAGE_SIZE,
    offset: int = 0,
    q: str | None = None,
    fix_offset: bool = True,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """One page of active subjects, newest first, with the total of all matches.

    An offset past the end shows the last page. Pages near the start are a
    top-k; deep ones are found by row number.
    """
    found = df.where((F.col("status") == "active") & matches_query("label", "id", q))
    total = found.count()
    if fix_offset and total and offset >= total:
        offset = (total - 1) // limit * limit
    if offset + limit <= SHALLOW_ROWS:
        ordered = found.orderBy(F.col("created_at").desc(), F.col("id").asc())
        shown = ordered.offset(offset).limit(limit)
    else:
        numbered = row_numbers(found, [("created_at", False), ("id", True)], (), "_n", range_rows)
        shown = numbered.where((F.col("_n") > offset) & (F.col("_n") <= offset + limit)).drop("_n")
    return shown.withColumn("total", F.lit(total).cast("long"))


def profile(
    subjects: DataFrame, embeddings: DataFrame, part_rows: int = PROFILE_ROWS, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Subjects with the array of their embeddings, inactive ones included.

    A subject with more than ``part_rows`` embeddings has several rows, told
    apart by ``part``, so no array grows without bound.
    """
    entry = F.struct("created_at", "id", "pipeline", "model", "dim", "is_active")
    order = [("created_at", True), ("id", True)]
    numbered = row_numbers(embeddings, order, ["person_id"], "_n", range_rows)
    nested = numbered.groupBy(
        F.col("person_id").alias("id"), F.floor((F.col("_n") - 1) / part_rows).cast("int").alias("part")
    ).agg(F.array_sort(F.collect_list(entry)).alias("embeddings"))
    empty = F.array().cast(nested.schema["embeddings"].dataType)
    return subjects.join(nested, "id", "left").withColumns(
        {"part": F.coalesce("part", F.lit(0)), "embeddings": F.coalesce("embeddings", empty)}
    )


def affected_pipelines(active_rows: DataFrame) -> DataFrame:
    return active_rows.agg(F.array_sort(F.collect_set("pipeline")).alias("affected"))


def soft_delete(subjects: DataFrame, embeddings: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mark subjects deleted and their embeddings inactive.

    ``ids`` is ``(id)``. Returns subjects, embeddings and ``(person_id,
    affected)`` with the spaces that had active rows.
    """
    gone = ids.select("id").distinct().withColumn("_gone", F.lit(True))
    people = subjects.join(gone, "id", "left").withColumn(
        "status", F.when(F.col("_gone"), "deleted").otherwise(F.col("status"))
    )
    marked = embeddings.join(gone.withColumnRenamed("id", "person_id"), "person_id", "left")
    affected = (
        marked.where(F.col("_gone") & F.col("is_active"))
        .groupBy("person_id")
        .agg(F.array_sort(F.collect_set("pipeline")).alias("affected"))
    )
    rows = marked.withColumn("is_active", F.col("is_active") & F.col("_gone").isNull()).drop("_gone")
    return people.drop("_gone"), rows, affected


def newest_per_label(subjects: DataFrame, keep: str = "newest") -> DataFrame:
    """``(label, id)``: the active subject that stands for each label."""
    micros = F.unix_micros(F.col("created_at").cast("timestamp"))
    age = -micros if keep == "newest" else micros
    return (
        subjects.where("status = 'active' AND label IS NOT NULL")
        .groupBy("label")
        .agg(F.min(F.struct(age.alias("_a"), F.col("id").alias("id")))["id"].alias("id"))
    )


def collapse_duplicates(
    subjects: DataFrame, embeddings: DataFrame, keep: str = "newest"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keep one active subject per label and soft-delete the others."""
    kept = newest_per_label(subjects, keep).select("id")
    extra = subjects.where("status = 'active' AND label IS NOT NULL").join(kept, "id", "left_anti")
    return soft_delete(subjects, embeddings, extra.select("id"))


def deactivate(
    embeddings: DataFrame, persons: DataFrame, pipelines: Collection[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Switch off embeddings of ``persons (id)``, optionally of some spaces."""
    hit = persons.select(F.col("id").alias("person_id")).distinct().withColumn("_hit", F.lit(True))
    marked = embeddings.join(hit, "person_id", "left")
    off = F.coalesce("_hit", F.lit(False)) & F.col("is_active")
    if pipelines:
        off = off & F.col("pipeline").isin(*pipelines)
    affected = affected_pipelines(marked.where(off))
    return marked.withColumn("is_active", F.col("is_active") & ~off).drop("_hit"), affected


def enroll(subjects: DataFrame, embeddings: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add a batch ``(request_id, label, pipeline, model, dim, vector, created_at)``.

    A label names the newest active subject with it, or one new subject for the
    whole batch; a request without a label always makes its own subject.
    """
    label = strip("label")
    requests = batch.withColumn("label", F.when(label != "", label))
    known = newest_per_label(subjects).withColumnRenamed("id", "_known")
    named = requests.join(known, "label", "left")
    new_id = F.when(F.col("label").isNotNull(), uuid5(F.lit("subject"), "label", "_first")).otherwise(
        uuid5(F.lit("subject-request"), "request_id")
    )
    first = requests.where("label IS NOT NULL").groupBy("label").agg(F.min("request_id").alias("_first"))
    id_type = subjects.schema["id"].dataType
    placed = (
        named.join(first, "label", "left")
        .withColumn("_new", F.col("_known").isNull())
        .withColumn("person_id", F.coalesce(F.col("_known").cast("string"), new_id).cast(id_type))
    )
    people = placed.where("_new").groupBy(F.col("person_id").alias("id")).agg(
        F.first("label", ignorenulls=True).alias("label"), F.min("created_at").alias("created_at")
    )
    people = people.withColumns({"status": F.lit("active"), "updated_at": F.col("created_at")})
    rows = placed.select(
        uuid5(F.lit("embedding"), "request_id", "pipeline", "model").alias("id"),
        "person_id",
        "pipeline",
        "model",
        "dim",
        "vector",
        "created_at",
        F.lit(True).alias("is_active"),
    )
    return subjects.unionByName(people.select(*subjects.columns)), embeddings.unionByName(rows.select(*embeddings.columns))


def import_join(mapping: DataFrame, vectors: DataFrame) -> DataFrame:
    """Attach vectors to mapping rows ``(row_id, identity, …)``.

    A row id outside the vector table raises when the result is read.
    """
    joined = mapping.join(vectors.select("row_id", "v"), "row_id", "left")
    message = F.concat(F.lit("mapping row_id not in the vector table: "), F.col("row_id").cast("string"))
    problem = F.raise_error(message).cast("array<double>")
    return joined.withColumn("v", F.when(F.col("v").isNull(), problem).otherwise(F.col("v")))


def missing_rows(mapping: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mapping rows without a vector."""
    return mapping.join(vectors.select("row_id"), "row_id", "left_anti")


def import_rows(new: DataFrame, existing: DataFrame, mode: str = "skip") -> DataFrame:
    """Existing embeddings plus the new ones.

    ``skip`` leaves out subjects that already have active rows in the space;
    ``replace`` switches those rows off first.
    """
    space = ["person_id", "pipeline", "model"]
    active = existing.where("is_active").select(*space).distinct()
    if mode == "skip":
        return existing.unionByName(new.join(active, space, "left_anti").select(*existing.columns))
    touched = new.select(*space).distinct().withColumn("_new", F.lit(True))
    off = existing.join(touched, space, "left").withColumn(
        "is_active", F.col("is_active") & F.col("_new").isNull()
    )
    return off.select(*existing.columns).unionByName(new.select(*existing.columns))


@dataclass(frozen=True)
class ImportConfig:
    pipeline: str
    model: str
    prefix: str
    replace: bool = False


def import_gallery(
    mapping: DataFrame,
    vectors: DataFrame,
    subjects: DataFrame,
    embeddings: DataFrame,
    config: ImportConfig,
    created_at: Column,
) -> tuple[DataFrame, DataFrame]:
    """Bulk import of ``mapping (row_id, identity)`` under a label prefix.

    Ids follow from the content, so importing twice gives the same rows.
    Earlier rows of the prefix and space raise, or are removed with
    ``replace``, and their subjects with them unless these have rows in another
    space. Rows of other spaces stay as they are.
    """
    space = (F.col("pipeline") == config.pipeline) & (F.col("model") == config.model)
    own = subjects.where(F.col("label").startswith(config.prefix + " ")).select(F.col("id").alias("person_id"))
    if config.replace:
        old = embeddings.join(own, "person_id", "left_semi").where(space)
        embeddings = embeddings.join(old.select("id"), "id", "left_anti")
        gone = own.join(embeddings.select("person_id"), "person_id", "left_anti")
        subjects = subjects.join(gone.withColumnRenamed("person_id", "id"), "id", "left_anti")
    elif not embeddings.where(space).join(own, "person_id", "left_semi").isEmpty():
        raise ValueError(f"rows of prefix {config.prefix!r} exist; set replace to remove them")

    space_parts = [F.lit(config.pipeline), F.lit(config.model)]
    person = uuid5(F.lit("import-subject"), *space_parts, F.lit(config.prefix), "identity")
    joined = import_join(mapping, vectors)
    rows = joined.where(is_usable("v")).withColumn("unit", l2_normalize("v"))
    people = mapping.select("identity").distinct().select(
        person.alias("id"),
        F.concat(F.lit(config.prefix + " "), F.col("identity")).alias("label"),
        F.lit("active").alias("status"),
        created_at.alias("created_at"),
        created_at.alias("updated_at"),
    )
    added = rows.select(
        uuid5(F.lit("import-embedding"), *space_parts, "row_id", "identity").alias("id"),
        person.alias("person_id"),
        F.lit(config.pipeline).alias("pipeline"),
        F.lit(config.model).alias("model"),
        F.size("unit").alias("dim"),
        F.col("unit").alias("vector"),
        created_at.alias("created_at"),
        F.lit(True).alias("is_active"),
    )
    return subjects.unionByName(people.select(*subjects.columns)), embeddings.unionByName(added.select(*embeddings.columns))


def build_plan(
    embeddings: DataFrame,
    batch: int,
    train: int,
    limit: int | None = None,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Build order of live embeddings: position, batch number, training flag."""
    order = [("created_at", True), ("id", True)]
    # the numbering reads its input several times
    numbered = row_numbers(durable(embeddings), order, (), "position", range_rows)
    if limit is not None:
        numbered = numbered.where(F.col("position") <= limit)
    return numbered.withColumns(
        {
            "batch_no": F.floor((F.col("position") - 1) / batch),
            "in_training": F.col("position") <= train,
        }
    )


def index_coverage(embeddings: DataFrame, subjects: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Live templates against indexed vectors per space, absent sides as 0.

    ``snapshots`` is ``(pipeline, embeddings_count, created_at)``; the newest
    snapshot of a space counts.
    """
    live = live_embeddings(embeddings, subjects).groupBy("pipeline").agg(F.count(F.lit(1)).alias("templates"))
    newest = snapshots.groupBy("pipeline").agg(F.max_by("embeddings_count", "created_at").alias("indexed"))
    joined = live.join(newest, "pipeline", "full_outer").fillna(0, ["templates", "indexed"])
    return joined.withColumn("gap", F.col("templates") - F.col("indexed"))


def path_parts(path: Column) -> tuple[Column, Column, Column]:
    """Folder, first part of the file name, and suffix."""
    name = F.element_at(F.split(path, "/"), -1)
    folder = F.left(path, F.length(path) - F.length(name))
    return folder, F.split(name, r"\.")[0], F.regexp_extract(name, r"(\.[^.]*)$", 1)


def in_family(path: Column, base: str) -> Column:
    """Whether a snapshot path is ``base`` or ``base`` with a tag before the suffix."""
    folder, _, file = base.rpartition("/")
    stem, dot, suffix = file.rpartition(".")
    own_folder, _, own_suffix = path_parts(path)
    name = F.element_at(F.split(path, "/"), -1)
    tagged = (
        (own_folder == (folder + "/" if folder else ""))
        & (own_suffix == dot + suffix)
        & name.startswith(stem + ".")
    )
    return (path == base) | tagged


def latest_valid_snapshot(
    snapshots: DataFrame, files: DataFrame, expected: DataFrame
) -> DataFrame:
    """Newest usable snapshot of each family.

    ``snapshots`` is ``(id, family, path, pipeline, model, dim, sha256,
    map_sha256, created_at)`` where null metadata is accepted; ``files`` is
    ``(path, sha256)`` with the index and its ``.map.json`` beside it;
    ``expected`` is ``(family, want_pipeline, want_model, want_dim)``.
    """
    index_file = files.select("path", F.col("sha256").alias("_sha"))
    map_file = files.select(
        F.regexp_replace("path", r"\.map\.json$", "").alias("path"), F.col("sha256").alias("_map_sha"), F.col("path").alias("_map")
    ).where(F.col("_map").endswith(".map.json"))

    def agrees(stored: str, actual: str) -> Column:
        return F.col(stored).isNull() | (F.col(stored) == F.col(actual))

    usable = (
        snapshots.join(index_file, "path")
        .join(map_file.drop("_map"), "path")
        .join(expected, "family")
        .where(
            agrees("pipeline", "want_pipeline")
            & agrees("model", "want_model")
            & agrees("dim", "want_dim")
            & agrees("sha256", "_sha")
            & agrees("map_sha256", "_map_sha")
        )
    )
    newest = F.max(F.struct("created_at", "id", F.struct(*[F.col(c) for c in snapshots.columns]).alias("row")))["row"]
    return usable.groupBy("family").agg(newest.alias("row")).select("row.*")


def snapshot_retention(
    snapshots: DataFrame, n: int = SNAPSHOT_RETENTION, current: str | None = None, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Snapshots to remove: beyond the newest ``n`` of their family, not the current one."""
    if n <= 0:
        return snapshots.limit(0)
    order = [("created_at", False), ("id", False)]
    old = row_numbers(snapshots, order, ["family"], "_n", range_rows).where(F.col("_n") > n).drop("_n")
    return old if current is None else old.where(F.col("path") != current)
