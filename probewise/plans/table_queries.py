"""Registered queries over gallery tables, labels, datasets and files."""

from __future__ import annotations

import uuid
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probewise.functions import boxes, labels
from probewise.operators import datasets as ds
from probewise.operators import detections as det
from probewise.operators import gallery as gal
from probewise.operators import verification as ver
from probewise.operators.ordered import row_numbers
from probewise.plans import tables
from probewise.plans.registry import query
from probewise.plans.verify_queries import curve
from probewise.session import ensure_checkpoint_dir
from probewise.sources import files as src
from probewise.sources.store import GalleryStore


def scratch(spark: SparkSession) -> str:
    """A new folder for files a query writes and reads back."""
    return f"{ensure_checkpoint_dir(spark)}/probewise-{uuid.uuid4().hex}"


def stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def document_files(spark, sf_dir) -> DataFrame:
    """Documents as image files: the source is the identity folder."""
    suffix = F.when(F.col("n_chars") >= 1000, ".png").otherwise(".jpg")
    name = F.concat(F.lit("/data/"), "lang", F.lit("/"), "source", F.lit("/f"), F.col("doc_id").cast("string"), suffix)
    rows = tables.read(spark, sf_dir, "documents")
    return rows.select("doc_id", name.alias("path"), F.col("source").alias("identity"), "lang", "n_chars")


FILES = {
    "doc_files": """
        SELECT doc_id, '/data/' || lang || '/' || source || '/f' || doc_id ||
               CASE WHEN n_chars >= 1000 THEN '.png' ELSE '.jpg' END AS path, source AS identity, lang, n_chars
        FROM documents""",
}


# S: sources and sinks


@query(
    "s2_discover_files",
    """SELECT folder, row_number() OVER (ORDER BY folder || '/') AS place, TRUE AS gapless
       FROM (SELECT DISTINCT 'folder=' || coalesce(source, 'none') AS folder FROM documents)""",
)
def s2(spark, sf_dir):
    """Documents written out by source, beside files of another kind, and found again in path order."""
    place = scratch(spark)
    docs = tables.read(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("folder"), "text")
    docs.write.partitionBy("folder").text(f"{place}/kept")
    docs.select("folder").write.json(f"{place}/other")
    found = src.discover_files(spark, [place], [".TXT"])
    # how many files a folder has depends on the partitions it was written from
    folders = found.groupBy(F.element_at(F.split("path", "/"), -2).alias("folder")).agg(
        F.min("position").alias("first"), F.max("position").alias("last"), F.count(F.lit(1)).alias("files")
    )
    numbered = row_numbers(folders, [("first", True)], (), "place")
    return numbered.select("folder", "place", (F.col("last") - F.col("first") + 1 == F.col("files")).alias("gapless"))


LINES = {
    "pair_lines": """
        SELECT event_id + 1 AS line_number, 'U' || user_id AS a, 'U' || (props ->> '$.k') AS b,
               floor(value)::INT AS i, (props ->> '$.k')::INT AS k, event_type
        FROM events""",
    "parsed": """
        SELECT line_number, 1 AS label_same, a AS name1, i AS index1, a AS name2, k AS index2
        FROM pair_lines WHERE event_type = 'purchase'
        UNION ALL SELECT line_number, 0, a, i, b, k FROM pair_lines WHERE event_type = 'view'""",
}


def pair_lines(spark, sf_dir) -> DataFrame:
    """Lines of a pairs file: pairs, blanks, headers and broken lines by event type."""
    rows = tables.read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    a, b = F.concat(F.lit("U"), "user_id"), F.concat(F.lit("U"), k)
    i = F.floor("value").cast("string")
    kind = F.col("event_type")
    value = (
        F.when(kind == "purchase", F.concat_ws("  ", a, i, k))
        .when(kind == "view", F.concat_ws("\t", a, i, b, k))
        .when(kind == "error", "  ")
        .when(kind == "signup", F.concat_ws(" ", i, k))
        .otherwise(F.concat_ws(" ", a, i))
    )
    return rows.select((F.col("event_id") + 1).alias("line_number"), value.alias("value"))


@query(
    "s3_parse_pairs",
    """SELECT row_number() OVER (ORDER BY line_number) AS pair_id, *,
              '/img/' || name1 || '/' || name1 || '_' || lpad(index1::VARCHAR, greatest(4, length(index1::VARCHAR))::INT, '0') || '.jpg' AS path1,
              '/img/' || name2 || '/' || name2 || '_' || lpad(index2::VARCHAR, greatest(4, length(index2::VARCHAR))::INT, '0') || '.jpg' AS path2
       FROM parsed""",
    extra=LINES,
)
def s3(spark, sf_dir):
    return src.parse_pairs(pair_lines(spark, sf_dir), "/img/", lenient=True)


# the same lines as text files, one for each of eight parts
@query(
    "s3_pairs_folder",
    """SELECT row_number() OVER (ORDER BY part, line_number) AS pair_id, part, n AS line_number, label_same, name1, index1, name2, index2
       FROM parsed JOIN (SELECT line_number, line_number % 8 AS part, row_number() OVER (PARTITION BY line_number % 8 ORDER BY line_number) AS n
                         FROM pair_lines) USING (line_number)""",
    extra=LINES,
)
def s3_folder(spark, sf_dir):
    path = scratch(spark)
    lines = pair_lines(spark, sf_dir).withColumn("part", F.col("line_number") % 8)
    ordered = lines.repartition("part").sortWithinPartitions("part", "line_number").select("value", "part")
    ordered.write.partitionBy("part").text(path)
    pairs = src.read_pairs_folder(spark, [path], "/img", lenient=True)
    part = F.regexp_extract("path", "part=([0-9]+)/", 1).cast("long")
    return pairs.select("pair_id", part.alias("part"), "line_number", "label_same", "name1", "index1", "name2", "index2")


@query(
    "s4_read_manifest",
    """SELECT c_custkey::VARCHAR AS person_id, c_mktsegment AS label, c_name AS image_path
       FROM customer WHERE c_acctbal >= 0""",
)
def s4(spark, sf_dir):
    path = scratch(spark)
    rows = tables.read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("person_id"),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).otherwise(" ").alias("label"),
        F.col("c_name").alias("image_path"),
    )
    rows.write.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path, header=True)
    return src.read_manifest(spark, path, ["label", "image_path"])


@query(
    "s5_infer_identity",
    """SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN identity ELSE lang END AS identity FROM doc_files""",
    extra=FILES,
)
def s5(spark, sf_dir):
    files = document_files(spark, sf_dir).drop("identity")
    return ds.infer_identity(files, ["/data/en", "/data/de", "/data"]).select("doc_id", "identity")


@query("s6_write_report", "SELECT threshold, round(far, 6) AS far, round(frr, 6) AS frr, tp, fp, tn, fn FROM curve")
def s6(spark, sf_dir):
    path, columns = scratch(spark), ["threshold", "far", "frr", *ver.COUNTS]
    src.write_report(curve(spark, sf_dir), path, "csv", columns)
    types = "threshold double, far double, frr double, tp long, fp long, tn long, fn long"
    written = spark.read.schema(types).csv(path, header=True)
    return written.withColumns({"far": F.round("far", 6), "frr": F.round("frr", 6)})


@query(
    "s7_read_metrics",
    """SELECT n_name AS run, count(*) AS valid_pairs, round(avg(c_acctbal) / 100000, 4) AS eer
       FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def s7(spark, sf_dir):
    path = scratch(spark)
    joined = tables.read(spark, sf_dir, "nation").join(
        tables.read(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    runs = joined.groupBy(F.col("n_name").alias("run")).agg(
        F.count(F.lit(1)).alias("valid_pairs"), F.round(F.avg("c_acctbal") / 100000, 4).alias("eer")
    )
    # a file per run, and one per run that is cut off in the middle
    text = F.to_json(F.struct("run", "valid_pairs", "eer"))
    broken = F.concat(F.lit("{\"run\": "), "run")
    both = runs.select("run", F.explode(F.array(text, broken)).alias("value"))
    both = both.withColumn("part", F.when(F.col("value").endswith("}"), 0).otherwise(1))
    both.write.partitionBy("run", "part").text(path)
    found = src.read_metrics(spark, f"{path}/*/*", "run string, valid_pairs long, eer double")
    return found.select("run", "valid_pairs", "eer")


@query(
    "s8_verify_manifest",
    """SELECT doc_id, CASE WHEN lang = 'de' THEN 'malformed' WHEN l.doc_id IS NULL THEN 'missing'
                           WHEN contains(text, chr(10)) THEN 'mismatch' ELSE 'ok' END AS status
       FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""",
)
def s8(spark, sf_dir):
    documents = tables.read(spark, sf_dir, "documents")
    present = tables.read(spark, sf_dir, "labels").select("doc_id").distinct()
    path = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    stored = documents.join(present, "doc_id").select(path.alias("path"), F.col("text").cast("binary").alias("content"))
    expected = F.sha2(F.replace("text", F.lit("\n"), F.lit(" ")), 256)
    separator = F.when(F.col("lang") == "de", " ").otherwise(src.CHECKSUM_SEPARATOR)
    lines = documents.select(F.col("doc_id").alias("line_number"), F.concat(expected, separator, path).alias("value"))
    checked = src.verify_manifest(stored, src.parse_checksums(lines))
    return checked.select(F.col("line_number").alias("doc_id"), "status")


# P: labels and detections


@query(
    "p1_search_subjects",
    "SELECT id, label FROM subjects WHERE status = 'active' AND (contains(lower(label), 'build') OR id::VARCHAR = 'build')",
)
def p1(spark, sf_dir):
    rows = tables.subjects(spark, sf_dir)
    return rows.where((F.col("status") == "active") & labels.matches_query("label", "id", " BuilD ")).select("id", "label")


SCALE = {
    "marked": """
        SELECT p_partkey, CASE WHEN p_size < 10 THEN 'Dataset Identity ' || p_name WHEN p_size < 20 THEN 'scale person ' || p_name
               WHEN p_size < 30 THEN p_name || ' #Scale' ELSE p_name END AS label FROM part""",
}


def marked_parts(spark, sf_dir) -> DataFrame:
    size, name = F.col("p_size"), F.col("p_name")
    label = (
        F.when(size < 10, F.concat(F.lit("Dataset Identity "), name))
        .when(size < 20, F.concat(F.lit("scale person "), name))
        .when(size < 30, F.concat(name, F.lit(" #Scale")))
        .otherwise(name)
    )
    return tables.read(spark, sf_dir, "part").select("p_partkey", label.alias("label"))


@query(
    "p2_is_scale_label",
    """SELECT p_partkey, starts_with(label, 'Dataset Identity ') OR starts_with(label, 'Scale Person ')
              OR contains(upper(label), '#SCALE') AS is_scale FROM marked""",
    extra=SCALE,
)
def p2(spark, sf_dir):
    return marked_parts(spark, sf_dir).select("p_partkey", labels.is_scale_label("label").alias("is_scale"))


@query("p3_clean_label", "SELECT p_partkey, trim(replace(p_name, '_', ' ')) || ' ' || lower(p_type) AS label FROM part")
def p3(spark, sf_dir):
    raw = F.concat(F.lit("AC__"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.lower("p_type"), F.lit("_"))
    return tables.read(spark, sf_dir, "part").select("p_partkey", labels.clean_label(raw).alias("label"))


@query(
    "p4_identity_key",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'person:' || c_custkey ELSE 'label:' || lower(c_name) END AS identity_key
       FROM customer""",
)
def p4(spark, sf_dir):
    label = F.when(F.col("c_acctbal") < 0, " ").otherwise(F.concat(F.lit("\t"), "c_name", F.lit(" ")))
    rows = tables.read(spark, sf_dir, "customer")
    return rows.select("c_custkey", labels.identity_key(label, "c_custkey").alias("identity_key"))


CROPS = {
    "crops": """
        SELECT *, greatest(0, bbox[3] - bbox[1]) AS w, greatest(0, bbox[4] - bbox[2]) AS h,
               greatest(0, round_even(bbox[1], 0)::BIGINT) AS l, greatest(0, round_even(bbox[2], 0)::BIGINT) AS t,
               least(width, round_even(bbox[3], 0)::BIGINT) AS r, least(height, round_even(bbox[4], 0)::BIGINT) AS b
        FROM detections""",
}


@query(
    "p5_quality_gate",
    """SELECT image_id, face_index,
              CASE WHEN det_score < 0.05 THEN 'low_score' WHEN bbox IS NULL THEN 'missing_box'
                   WHEN w < 30 OR h < 30 THEN 'small_box'
                   WHEN width IS NULL THEN NULL
                   WHEN r <= l OR b <= t THEN 'empty_crop'
                   WHEN (r - l) * (b - t) / (width * height) < 0.2 THEN 'small_area'
                   WHEN blur < 20 THEN 'blurry' END AS reject_reason
       FROM crops""",
    extra=CROPS,
)
def p5(spark, sf_dir):
    gated = det.quality_gate(tables.detections(spark, sf_dir), 0.05, 30, 0.2, 20.0)
    return gated.select("image_id", "face_index", "reject_reason")


@query(
    "p6_box_geometry",
    """SELECT image_id, face_index, round(coalesce(w * h, 0), 6) AS area,
              CASE WHEN bbox IS NOT NULL THEN round(greatest(0, bbox[1] - 0.25 * w), 6) END AS ex1,
              CASE WHEN bbox IS NOT NULL AND width IS NOT NULL THEN round(least(width, bbox[3] + 0.25 * w), 6) END AS ex2,
              round(bbox[2] * 1.5, 6) AS sy1,
              floor((width - least(width, height)) / 2)::DOUBLE AS cx1,
              floor((width - least(width, height)) / 2)::DOUBLE + least(width, height) AS cx2
       FROM crops""",
    extra=CROPS,
)
def p6(spark, sf_dir):
    rows = tables.detections(spark, sf_dir)
    grown = boxes.expand_box("bbox", 0.25, "width", "height")
    center = boxes.center_box("width", "height")
    return rows.select(
        "image_id",
        "face_index",
        F.round(boxes.box_area("bbox"), 6).alias("area"),
        F.round(grown[0], 6).alias("ex1"),
        F.round(grown[2], 6).alias("ex2"),
        F.round(boxes.scale_box("bbox", 2.0, 1.5)[1], 6).alias("sy1"),
        center[0].alias("cx1"),
        center[2].alias("cx2"),
    )


@query(
    "p7_pick_detection",
    """SELECT image_id, face_index, det_score, faces FROM (
           SELECT *, count(*) OVER (PARTITION BY image_id) AS faces,
                  row_number() OVER (PARTITION BY image_id ORDER BY coalesce(w * h, 0) + det_score * 0.001 DESC, face_index) AS pick
           FROM crops) WHERE pick = 1""",
    extra=CROPS,
)
def p7(spark, sf_dir):
    picked = det.pick_detection(tables.detections(spark, sf_dir), "largest_scored")
    return picked.select("image_id", "face_index", "det_score", "faces")


@query(
    "p7_single_face_status",
    """SELECT e.image_id, coalesce(d.faces, 0) AS faces,
              CASE WHEN coalesce(d.faces, 0) = 0 THEN 'no_face' WHEN d.faces > 1 THEN 'multiple_faces' ELSE 'ok' END AS status
       FROM (SELECT DISTINCT image_id FROM detections) e
       LEFT JOIN (SELECT image_id, count(*) AS faces FROM detections WHERE det_score >= 0.5 GROUP BY image_id) d USING (image_id)""",
)
def p7_status(spark, sf_dir):
    rows = tables.detections(spark, sf_dir)
    return det.single_face_status(rows.select("image_id"), rows.where("det_score >= 0.5"))


@query(
    "p8_nms",
    """SELECT image_id, face_index, det_score FROM kept_boxes WHERE stays""",
    extra={
        "box_ranks": """
            SELECT image_id, face_index, det_score, bbox,
                   row_number() OVER (PARTITION BY image_id ORDER BY det_score DESC, face_index) AS place
            FROM detections WHERE bbox IS NOT NULL""",
        "kept_boxes": """
            SELECT image_id, face_index, det_score, place, [bbox] AS boxes, true AS stays FROM box_ranks WHERE place = 1
            UNION ALL
            SELECT image_id, face_index, det_score, place, CASE WHEN stays THEN list_append(boxes, bbox) ELSE boxes END, stays
            FROM (SELECT n.*, k.boxes,
                         len(list_filter(k.boxes, lambda o:
                             greatest(least(o[3], n.bbox[3]) - greatest(o[1], n.bbox[1]), 0) *
                             greatest(least(o[4], n.bbox[4]) - greatest(o[2], n.bbox[2]), 0) /
                             ((o[3] - o[1]) * (o[4] - o[2]) + (n.bbox[3] - n.bbox[1]) * (n.bbox[4] - n.bbox[2]) -
                              greatest(least(o[3], n.bbox[3]) - greatest(o[1], n.bbox[1]), 0) *
                              greatest(least(o[4], n.bbox[4]) - greatest(o[2], n.bbox[2]), 0) + 0.000001) > 0.4)) = 0 AS stays
                  FROM kept_boxes k JOIN box_ranks n ON n.image_id = k.image_id AND n.place = k.place + 1)""",
    },
    recursive=True,
)
def p8(spark, sf_dir):
    rows = tables.detections(spark, sf_dir).where("bbox IS NOT NULL")
    return det.nms(rows.select("image_id", "face_index", "bbox", "det_score")).select("image_id", "face_index", "det_score")


# J9, J10 and G: table maintenance


MAPPING = {
    "mapping": "SELECT vec_id AS row_id, 'L' || label AS identity FROM vec",
    "old_keys": "SELECT DISTINCT person_id, pipeline, model FROM templates WHERE is_active",
    "new_rows": """
        SELECT 1000000000 + l_orderkey * 10 + l_linenumber AS id, l_suppkey AS person_id,
               CASE WHEN l_discount > 0.05 THEN 'custom' ELSE 'pretrained' END AS pipeline,
               CASE WHEN l_returnflag = 'A' THEN '1-URGENT' ELSE '5-LOW' END AS model
        FROM lineitem""",
}


@query(
    "j9_import_join",
    "SELECT m.row_id, m.identity, round(v[1], 6) AS first FROM mapping m JOIN vec ON vec_id = m.row_id",
    extra=MAPPING,
)
def j9(spark, sf_dir):
    base = tables.vectors(spark, sf_dir).withColumnRenamed("vec_id", "row_id")
    mapping = base.select("row_id", F.concat(F.lit("L"), "label").alias("identity"))
    return gal.import_join(mapping, base).select("row_id", "identity", F.round(F.col("v")[0], 6).alias("first"))


def new_rows(spark, sf_dir) -> DataFrame:
    return tables.read(spark, sf_dir, "lineitem").select(
        (F.lit(1000000000) + F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_suppkey").alias("person_id"),
        F.when(F.col("l_discount") > 0.05, "custom").otherwise("pretrained").alias("pipeline"),
        F.when(F.col("l_returnflag") == "A", "1-URGENT").otherwise("5-LOW").alias("model"),
        F.lit(512).alias("dim"),
        F.col("l_shipdate").alias("created_at"),
        F.lit(True).alias("is_active"),
    )


@query(
    "j10_import_rows_skip",
    """SELECT pipeline, model, is_active, count(*) AS rows, sum(id)::BIGINT AS ids FROM (
           SELECT id, pipeline, model, is_active FROM templates
           UNION ALL SELECT n.id, n.pipeline, n.model, true FROM new_rows n
           WHERE NOT EXISTS (SELECT 1 FROM old_keys o
                             WHERE o.person_id = n.person_id AND o.pipeline = n.pipeline AND o.model = n.model))
       GROUP BY ALL""",
    extra=MAPPING,
)
def j10(spark, sf_dir):
    return counted(gal.import_rows(new_rows(spark, sf_dir), tables.templates(spark, sf_dir), "skip"))


@query(
    "j10_import_rows_replace",
    """SELECT pipeline, model, is_active, count(*) AS rows, sum(id)::BIGINT AS ids FROM (
           SELECT id, pipeline, model, is_active AND NOT EXISTS (
                      SELECT 1 FROM new_rows n
                      WHERE n.person_id = t.person_id AND n.pipeline = t.pipeline AND n.model = t.model) AS is_active
           FROM templates t
           UNION ALL SELECT id, pipeline, model, true FROM new_rows)
       GROUP BY ALL""",
    extra=MAPPING,
)
def j10_replace(spark, sf_dir):
    return counted(gal.import_rows(new_rows(spark, sf_dir), tables.templates(spark, sf_dir), "replace"))


def counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("pipeline", "model", "is_active").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("id").alias("ids")
    )


@query(
    "g1_gallery_stats",
    """SELECT pipeline, model, count(*) AS embeddings, NULL::BIGINT AS active_persons FROM live GROUP BY pipeline, model
       UNION ALL SELECT NULL, NULL, (SELECT count(*) FROM live), (SELECT count(*) FROM subjects WHERE status = 'active')""",
)
def g1(spark, sf_dir):
    return gal.gallery_stats(tables.templates(spark, sf_dir), tables.subjects(spark, sf_dir))


@query(
    "g2_page",
    """SELECT id, label, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, total
       FROM (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY created_at DESC, id) AS n
             FROM subjects WHERE status = 'active' AND contains(lower(label), 'mach'))
       WHERE (n - 1) // 50 = least(2, (total - 1) // 50)""",
)
def g2(spark, sf_dir):
    rows = gal.page(tables.subjects(spark, sf_dir), limit=50, offset=100, q="mach")
    return rows.select("id", "label", stamp("created_at"), "total")


@query(
    "g3_profile",
    """SELECT s.id, s.label, count(t.id) AS templates, count(t.id) FILTER (WHERE t.is_active) AS active,
              arg_min(t.id, struct_pack(c := t.created_at, i := t.id)) AS first_id
       FROM subjects s LEFT JOIN templates t ON t.person_id = s.id GROUP BY s.id, s.label""",
)
def g3(spark, sf_dir):
    nested = gal.profile(tables.subjects(spark, sf_dir), tables.templates(spark, sf_dir))
    entries = F.col("embeddings")
    parts = nested.groupBy("id", "label").agg(
        F.sum(F.size(entries)).alias("templates"),
        F.sum(F.size(F.filter(entries, lambda e: e["is_active"]))).alias("active"),
        F.min(F.when(F.col("part") == 0, F.get(entries, F.lit(0))["id"])).alias("first_id"),
    )
    return parts


GONE = {
    "gone": "SELECT DISTINCT c_custkey AS id FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 400000",
    "standing": """
        SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY label ORDER BY created_at DESC, id) AS n
                        FROM subjects WHERE status = 'active') WHERE n = 1""",
    "extra_subjects": "SELECT id FROM subjects WHERE status = 'active' AND id NOT IN (SELECT id FROM standing)",
}


def gone(spark, sf_dir) -> DataFrame:
    return tables.read(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("id"))


@query(
    "g4_soft_delete",
    """SELECT s.id, CASE WHEN g.id IS NOT NULL THEN 'deleted' ELSE s.status END AS status,
              coalesce(t.active, 0) AS active, CASE WHEN g.id IS NOT NULL THEN t.spaces END AS affected
       FROM subjects s LEFT JOIN gone g ON g.id = s.id
       LEFT JOIN (SELECT person_id, count(*) FILTER (WHERE is_active AND person_id NOT IN (SELECT id FROM gone)) AS active,
                         string_agg(DISTINCT pipeline, ',' ORDER BY pipeline) FILTER (WHERE is_active) AS spaces
                  FROM templates GROUP BY person_id) t ON t.person_id = s.id""",
    extra=GONE,
)
def g4(spark, sf_dir):
    parts = gal.soft_delete(tables.subjects(spark, sf_dir), tables.templates(spark, sf_dir), gone(spark, sf_dir))
    return deletion_report(*parts)


def deletion_report(people: DataFrame, rows: DataFrame, affected: DataFrame) -> DataFrame:
    active = rows.groupBy(F.col("person_id").alias("id")).agg(F.sum(F.col("is_active").cast("long")).alias("active"))
    named = affected.select(F.col("person_id").alias("id"), F.array_join("affected", ",").alias("affected"))
    joined = people.join(active, "id", "left").join(named, "id", "left")
    return joined.select("id", "status", F.coalesce("active", F.lit(0)).alias("active"), "affected")


@query(
    "g5_collapse_duplicates",
    """SELECT s.id, CASE WHEN g.id IS NOT NULL THEN 'deleted' ELSE s.status END AS status,
              coalesce(t.active, 0) AS active, CASE WHEN g.id IS NOT NULL THEN t.spaces END AS affected
       FROM subjects s LEFT JOIN extra_subjects g ON g.id = s.id
       LEFT JOIN (SELECT person_id, count(*) FILTER (WHERE is_active AND person_id NOT IN (SELECT id FROM extra_subjects)) AS active,
                         string_agg(DISTINCT pipeline, ',' ORDER BY pipeline) FILTER (WHERE is_active) AS spaces
                  FROM templates GROUP BY person_id) t ON t.person_id = s.id""",
    extra=GONE,
)
def g5(spark, sf_dir):
    return deletion_report(*gal.collapse_duplicates(tables.subjects(spark, sf_dir), tables.templates(spark, sf_dir)))


# the same tables as a store that is changed in place
BUCKETS = 64


def gallery_store(spark, sf_dir) -> GalleryStore:
    return GalleryStore.create(f"{scratch(spark)}/store", tables.subjects(spark, sf_dir), tables.templates(spark, sf_dir), BUCKETS)


def few_subjects(spark, sf_dir) -> DataFrame:
    return tables.subjects(spark, sf_dir).where("id % 150 = 7").select("id")


def store_rows(store: GalleryStore) -> DataFrame:
    states = store.subjects.select(F.col("id").alias("person_id"), "status")
    return store.embeddings.join(states, "person_id", "left").select("id", "person_id", "is_active", "status")


def bucket_sql(key: str) -> str:
    return f"('0x' || substr(md5({key}::VARCHAR), 1, 8))::BIGINT % {BUCKETS}"


@query(
    "g4_delete_in_place",
    """SELECT t.id, t.person_id, t.is_active AND t.person_id % 150 <> 7 AS is_active,
              CASE WHEN s.id % 150 = 7 THEN 'deleted' ELSE s.status END AS status
       FROM templates t LEFT JOIN subjects s ON s.id = t.person_id""",
)
def g4_in_place(spark, sf_dir):
    store = gallery_store(spark, sf_dir)
    store.soft_delete(few_subjects(spark, sf_dir))
    return store_rows(store)


# which partitions a deletion writes, and that a second one writes none
@query(
    "g4_partitions_written",
    f"""SELECT 'subjects' AS table_name, 1 AS run, count(DISTINCT {bucket_sql('id')}) AS partitions
        FROM subjects WHERE id % 150 = 7 AND status <> 'deleted'
        UNION ALL SELECT 'embeddings', 1, count(DISTINCT {bucket_sql('person_id')}) FROM templates JOIN subjects s ON s.id = person_id
        WHERE person_id % 150 = 7 AND is_active
        UNION ALL SELECT 'subjects', 2, 0 UNION ALL SELECT 'embeddings', 2, 0""",
)
def g4_written(spark, sf_dir):
    store, ids = gallery_store(spark, sf_dir), few_subjects(spark, sf_dir)
    rows = [(name, run, len(touched)) for run in (1, 2) for name, touched in store.soft_delete(ids).items()]
    return spark.createDataFrame(rows, "table_name string, run int, partitions long")


@query(
    "g5_collapse_in_place",
    """SELECT t.id, t.person_id, t.is_active AND g.id IS NULL AS is_active,
              CASE WHEN g.id IS NOT NULL THEN 'deleted' ELSE s.status END AS status
       FROM templates t LEFT JOIN subjects s ON s.id = t.person_id LEFT JOIN extra_subjects g ON g.id = s.id""",
    extra=GONE,
)
def g5_in_place(spark, sf_dir):
    store = gallery_store(spark, sf_dir)
    store.collapse_duplicates()
    return store_rows(store)


# new embeddings of some subjects replace their rows of the space
@query(
    "j10_import_in_place",
    """SELECT id, person_id, is_active AND NOT EXISTS (
                  SELECT 1 FROM templates n WHERE n.id % 97 = 3 AND n.person_id = t.person_id AND n.pipeline = t.pipeline AND n.model = t.model) AS is_active
       FROM templates t
       UNION ALL SELECT -id, person_id, true FROM templates WHERE id % 97 = 3""",
)
def j10_in_place(spark, sf_dir):
    store = gallery_store(spark, sf_dir)
    picked = tables.templates(spark, sf_dir).where("id % 97 = 3")
    new = picked.withColumns({"id": -F.col("id"), "is_active": F.lit(True)})
    store.import_rows(new, "replace")
    # a repeated import finds its rows and changes nothing
    store.import_rows(new, "replace")
    return store.embeddings.select("id", "person_id", "is_active")


@query(
    "g6_deactivate",
    """SELECT pipeline, model, is_active AND NOT (pipeline = 'custom' AND person_id IN (SELECT id FROM gone)) AS is_active,
              count(*) AS rows, sum(id)::BIGINT AS ids FROM templates GROUP BY ALL""",
    extra=GONE,
)
def g6(spark, sf_dir):
    rows, _ = gal.deactivate(tables.templates(spark, sf_dir), gone(spark, sf_dir), ["custom"])
    return counted(rows)


ENROLL = {
    "batch": """
        SELECT s_suppkey AS request_id,
               CASE WHEN s_acctbal < 0 THEN NULL WHEN s_acctbal < 5000 THEN 'BUILDING_' || s_nationkey ELSE 'New ' || s_nationkey END AS label
        FROM supplier""",
    "standing_rows": "SELECT s.id, s.label FROM subjects s JOIN standing USING (id)",
    "placed": """
        SELECT b.*, st.id AS known FROM batch b LEFT JOIN standing_rows st ON st.label = b.label""",
}


@query(
    "g7_enroll",
    """SELECT (SELECT count(*) FROM subjects) + count(*) FILTER (WHERE label IS NULL)
              + count(DISTINCT label) FILTER (WHERE known IS NULL) AS subjects,
              (SELECT count(*) FROM templates) + count(*) AS embeddings,
              count(*) FILTER (WHERE known IS NOT NULL) AS reused,
              count(DISTINCT known) AS reused_subjects
       FROM placed""",
    extra={**GONE, **ENROLL},
)
def g7(spark, sf_dir):
    people = tables.subjects(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    rows = tables.templates(spark, sf_dir).withColumns(
        {"id": F.col("id").cast("string"), "person_id": F.col("person_id").cast("string"), "vector": F.lit(None).cast("binary")}
    )
    balance, nation = F.col("s_acctbal"), F.col("s_nationkey").cast("string")
    label = (
        F.when(balance < 0, F.lit(None))
        .when(balance < 5000, F.concat(F.lit("  BUILDING_"), nation))
        .otherwise(F.concat(F.lit("New "), nation, F.lit(" ")))
    )
    batch = tables.read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("request_id"),
        label.alias("label"),
        F.lit("custom").alias("pipeline"),
        F.lit("m").alias("model"),
        F.lit(512).alias("dim"),
        F.lit(None).cast("binary").alias("vector"),
        F.lit(tables.EPOCH).cast("timestamp_ntz").alias("created_at"),
    )
    people_after, rows_after = gal.enroll(people, rows, batch)
    added = rows_after.join(rows.select("id"), "id", "left_anti").join(
        people.select(F.col("id").alias("person_id")), "person_id", "left_semi"
    )
    return people_after.agg(F.count(F.lit(1)).alias("subjects")).select(
        "subjects",
        rows_after.agg(F.count(F.lit(1))).scalar().alias("embeddings"),
        added.agg(F.count(F.lit(1))).scalar().alias("reused"),
        added.agg(F.count_distinct("person_id")).scalar().alias("reused_subjects"),
    )


@query(
    "g8_import_gallery",
    """SELECT 'Import L' || label AS label, count(*) AS embeddings, 64 AS dim FROM vec GROUP BY vec.label""",
)
def g8(spark, sf_dir):
    base = tables.vectors(spark, sf_dir).withColumnRenamed("vec_id", "row_id")
    mapping = base.select("row_id", F.concat(F.lit("L"), "label").alias("identity"))
    people = tables.subjects(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    rows = tables.templates(spark, sf_dir).withColumns(
        {"id": F.col("id").cast("string"), "person_id": F.col("person_id").cast("string"), "vector": F.lit(None).cast("array<double>")}
    )
    config = gal.ImportConfig("custom", "m_import", "Import")
    people, rows = gal.import_gallery(mapping, base, people, rows, config, F.lit(tables.EPOCH).cast("timestamp_ntz"))
    live = gal.live_embeddings(rows, people, "custom", "m_import")
    named = live.join(people.select(F.col("id").alias("person_id"), "label"), "person_id")
    return named.groupBy("label").agg(F.count(F.lit(1)).alias("embeddings"), F.max("dim").alias("dim"))


@query(
    "g9_build_plan",
    """SELECT id, position, (position - 1) // 500 AS batch_no, position <= 2000 AS in_training FROM (
           SELECT id, row_number() OVER (ORDER BY created_at, id) AS position FROM live)""",
)
def g9(spark, sf_dir):
    live = gal.live_embeddings(tables.templates(spark, sf_dir), tables.subjects(spark, sf_dir))
    return gal.build_plan(live.select("id", "created_at"), 500, 2000).drop("created_at")


@query(
    "g10_index_coverage",
    """SELECT coalesce(l.pipeline, s.pipeline) AS pipeline, coalesce(l.n, 0) AS templates, coalesce(s.n, 0) AS indexed,
              coalesce(l.n, 0) - coalesce(s.n, 0) AS gap
       FROM (SELECT pipeline, count(*) AS n FROM live GROUP BY pipeline) l
       FULL JOIN (SELECT CASE WHEN p_size < 25 THEN 'custom' ELSE 'other' END AS pipeline,
                         arg_max(p_partkey, p_partkey) AS n FROM part GROUP BY 1) s ON s.pipeline = l.pipeline""",
)
def g10(spark, sf_dir):
    snapshots = tables.read(spark, sf_dir, "part").select(
        F.when(F.col("p_size") < 25, "custom").otherwise("other").alias("pipeline"),
        F.col("p_partkey").alias("embeddings_count"),
        F.col("p_partkey").alias("created_at"),
    )
    return gal.index_coverage(tables.templates(spark, sf_dir), tables.subjects(spark, sf_dir), snapshots)


SNAPSHOTS = {
    "snapshots": """
        SELECT p_partkey AS id, p_brand AS family, p_brand || '/' || p_partkey || '.faiss' AS path,
               CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'custom' END AS pipeline, p_size, p_type,
               p_retailprice AS created_at
        FROM part""",
}


def snapshot_rows(spark, sf_dir) -> DataFrame:
    """Index snapshots from the parts: the brand is the family, the price the age."""
    path = F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".faiss"))
    return tables.read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("family"),
        path.alias("path"),
        F.when(F.col("p_size") % 3 != 0, "custom").alias("pipeline"),
        F.lit("m").alias("model"),
        F.lit(512).alias("dim"),
        F.sha2(F.col("p_name"), 256).alias("sha256"),
        F.lit(None).cast("string").alias("map_sha256"),
        F.col("p_retailprice").alias("created_at"),
        "p_size",
        "p_type",
        "p_name",
    )


@query(
    "g11_latest_valid_snapshot",
    """SELECT family, arg_max(id, struct_pack(c := created_at, i := id)) AS id FROM snapshots
       WHERE p_size > 5 AND p_type <> 'ECONOMY' AND p_size < 45 GROUP BY family""",
    extra=SNAPSHOTS,
)
def g11(spark, sf_dir):
    rows = snapshot_rows(spark, sf_dir)
    # the index file of economy parts is gone, small parts have no map, big ones other bytes
    content = F.when(F.col("p_size") < 45, F.col("p_name")).otherwise(F.col("p_type"))
    index_files = rows.where("p_type <> 'ECONOMY'").select("path", F.sha2(content, 256).alias("sha256"))
    maps = rows.where("p_size > 5").select(F.concat("path", F.lit(".map.json")).alias("path"), "sha256")
    expected = rows.select("family").distinct().select(
        "family", F.lit("custom").alias("want_pipeline"), F.lit("m").alias("want_model"), F.lit(512).alias("want_dim")
    )
    newest = gal.latest_valid_snapshot(rows.drop("p_size", "p_type", "p_name"), index_files.unionByName(maps), expected)
    return newest.select("family", "id")


@query(
    "g12_snapshot_retention",
    """SELECT id, family FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY created_at DESC, id DESC) AS n FROM snapshots)
       WHERE n > 3""",
    extra=SNAPSHOTS,
)
def g12(spark, sf_dir):
    return gal.snapshot_retention(snapshot_rows(spark, sf_dir)).select("id", "family")


@query(
    "g13_dataset_summary",
    """SELECT count(*) AS identities, sum(n)::BIGINT AS images, min(n) AS min_images, round(avg(n), 2) AS avg_images, max(n) AS max_images,
              (SELECT string_agg(first, '|' ORDER BY identity) FROM (SELECT * FROM per_identity ORDER BY identity LIMIT 5)) AS samples
       FROM per_identity""",
    extra={**FILES, "per_identity": "SELECT identity, count(*) AS n, min(path) AS first FROM doc_files GROUP BY identity"},
)
def g13(spark, sf_dir):
    summary = ds.dataset_summary(document_files(spark, sf_dir))
    return summary.withColumn("samples", F.array_join("samples", "|"))


PREPARED = {
    **FILES,
    "kept": """
        SELECT identity FROM (SELECT identity, row_number() OVER (ORDER BY identity) AS n FROM (
            SELECT identity FROM doc_files GROUP BY identity HAVING count(*) >= 10)) WHERE n <= 15""",
    "codes": "SELECT doc_id, (quality + toxic)::VARCHAR AS code FROM labels",
    "prepared": """
        SELECT d.path AS filename, d.identity, CASE c.code WHEN '1' THEN 'val' WHEN '2' THEN 'test' ELSE 'train' END AS split
        FROM doc_files d JOIN kept USING (identity) LEFT JOIN codes c ON c.doc_id = d.doc_id""",
}


def prepared(spark, sf_dir) -> DataFrame:
    files = document_files(spark, sf_dir)
    codes = tables.read(spark, sf_dir, "labels").select(
        "doc_id", (F.col("quality") + F.col("toxic")).cast("string").alias("code")
    )
    names = files.select(F.col("path").alias("filename"), "identity", "doc_id")
    partitions = names.join(codes, "doc_id").select("filename", "code")
    return ds.prepare_dataset(names.select("filename"), names.select("filename", "identity"), partitions, 10, 15)


@query("g14_prepare_dataset", "SELECT * FROM prepared", extra=PREPARED)
def g14(spark, sf_dir):
    return prepared(spark, sf_dir)


@query(
    "g14_split_counts",
    "SELECT split, count(*) AS images, count(DISTINCT identity) AS identities FROM prepared GROUP BY split",
    extra=PREPARED,
)
def g14_counts(spark, sf_dir):
    return ds.split_counts(prepared(spark, sf_dir))


@query(
    "g15_split_per_identity",
    """SELECT doc_id, CASE WHEN n <= floor(total * 0.8) THEN 'train' ELSE 'val' END AS split FROM (
           SELECT doc_id, count(*) OVER (PARTITION BY identity) AS total,
                  row_number() OVER (PARTITION BY identity ORDER BY ends_with(path, '.jpg'), path) AS n FROM doc_files)""",
    extra=FILES,
)
def g15(spark, sf_dir):
    return ds.split_per_identity(document_files(spark, sf_dir), 0.8).select("doc_id", "split")


@query(
    "g16_class_index",
    "SELECT doc_id, dense_rank() OVER (ORDER BY identity) - 1 AS class_id FROM doc_files",
    extra=FILES,
)
def g16(spark, sf_dir):
    return ds.class_index(document_files(spark, sf_dir)).select("doc_id", "class_id")


class LetterCounter(ds.Extractor):
    """A stand-in for a model: counts four letters of a text."""

    letters = "aeno"

    def extract(self, content: bytes) -> tuple[str, np.ndarray | None]:
        text = content.decode("utf-8")
        if text.count("\n") > 20:
            return "multiple_faces", None
        if len(text) < 40:
            return "no_face", None
        return "ok", np.array([text.count(letter) for letter in self.letters], dtype=float)


LETTERS = {
    "letter_rows": """
        SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS lines, length(text) AS chars,
               [(length(text) - length(replace(text, 'a', '')))::DOUBLE, length(text) - length(replace(text, 'e', '')),
                length(text) - length(replace(text, 'n', '')), length(text) - length(replace(text, 'o', ''))] AS counts
        FROM documents""",
    "letters": """
        SELECT doc_id, counts, CASE WHEN lines > 20 THEN 'multiple_faces' WHEN chars < 40 THEN 'no_face'
               WHEN list_sum(counts) = 0 THEN 'error' ELSE 'ok' END AS status
        FROM letter_rows""",
}


def extracted(spark, sf_dir) -> DataFrame:
    path = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    files = tables.read(spark, sf_dir, "documents").select(path.alias("path"), F.col("text").cast("binary").alias("content"))
    return ds.extract_embeddings(files, LetterCounter)


@query("g17_extraction_outcomes", "SELECT status, count(*) AS files FROM letters GROUP BY status", extra=LETTERS)
def g17(spark, sf_dir):
    return ds.outcome_counts(extracted(spark, sf_dir))


# the same outcomes from a stream of documents that is started twice: the second run has nothing to do
@query(
    "g17_extract_stream",
    "SELECT status, count(*) AS files, 1::BIGINT AS runs FROM letters GROUP BY status",
    extra=LETTERS,
)
def g17_stream(spark, sf_dir):
    path = scratch(spark)
    documents = spark.readStream.schema(tables.read(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/document[s].parquet")
    key = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    files = documents.select(key.alias("path"), F.col("text").cast("binary").alias("content"))
    for _ in range(2):
        ds.extract_stream(files, LetterCounter, f"{path}/out", f"{path}/state").awaitTermination()
    stored = spark.read.parquet(f"{path}/out")
    runs = stored.groupBy("path", "status").agg(F.count(F.lit(1)).alias("runs"))
    return runs.groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.max("runs").alias("runs"))


@query(
    "g17_extracted_rows",
    """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, lpad(doc_id::VARCHAR, 12, '0') AS path,
              round(counts[1] / sqrt(list_inner_product(counts, counts)), 6) AS first FROM letters WHERE status = 'ok'""",
    extra=LETTERS,
)
def g17_rows(spark, sf_dir):
    good = ds.number_good_rows(extracted(spark, sf_dir))
    return good.select("row_id", "path", F.round(F.col("v")[0], 6).alias("first"))


@query(
    "g18_pending_files",
    "SELECT path FROM doc_files WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    extra=FILES,
)
def g18(spark, sf_dir):
    files = document_files(spark, sf_dir)
    cache = files.join(tables.read(spark, sf_dir, "labels"), "doc_id", "left_semi").select("path")
    return ds.pending_files(files.select("path"), cache)


BATCHES = {
    "batches": """
        SELECT user_id AS batch_id, event_id AS position, 'f' || event_id AS file,
               CASE WHEN event_type = 'error' THEN 'failed: ' || (props ->> '$.k') END AS error FROM events""",
}


def batches(spark, sf_dir) -> DataFrame:
    failed = F.concat(F.lit("failed: "), F.get_json_object("props", "$.k"))
    return tables.read(spark, sf_dir, "events").select(
        F.col("user_id").alias("batch_id"),
        F.col("event_id").alias("position"),
        F.concat(F.lit("f"), "event_id").alias("file"),
        F.when(F.col("event_type") == "error", failed).alias("error"),
    )


@query(
    "g19_batch_summary",
    """SELECT batch_id, count(*) AS requested, count(*) FILTER (WHERE error IS NULL) AS succeeded, count(error) AS failed
       FROM batches GROUP BY batch_id""",
    extra=BATCHES,
)
def g19(spark, sf_dir):
    return ds.batch_summary(batches(spark, sf_dir))


@query("g19_batch_errors", "SELECT * FROM batches WHERE error IS NOT NULL", extra=BATCHES)
def g19_errors(spark, sf_dir):
    return ds.batch_errors(batches(spark, sf_dir))
