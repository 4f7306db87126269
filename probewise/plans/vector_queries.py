"""Registered queries over vector columns, top-k joins and approximate search."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probewise.functions import vectors as V
from probewise.operators import approximate as ann
from probewise.operators import similarity as sim
from probewise.operators import vector_tables as vt
from probewise.operators.gallery import live_embeddings
from probewise.plans import tables
from probewise.operators.retrieval import topk_overlap
from probewise.plans.flows import read_codes, read_index, write_codes, write_index
from probewise.plans.registry import query
from probewise.plans.sql_tables import cos, inner, length, unit
from probewise.session import durable, ensure_checkpoint_dir

KEY_HEX = "000102030405060708090a0b0c0d0e0f101112131415161718191a1b1c1d1e1f"
OTHER_KEY_HEX = "ff" * 32
DIM = 64


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored payloads: encrypted, some under a lost key, some cut short."""
    rows = tables.gallery(spark, sf_dir)
    raw = V.encode_vector(F.col("v").cast("array<float>"))
    cut = F.when(F.col("v")[5] > 0.1875, F.substring("raw", 1, 4 * DIM - 1)).otherwise(F.col("raw"))
    sealed = (
        F.when(F.col("model") == "m_old", V.encrypt_payload("cut", OTHER_KEY_HEX))
        .when(F.col("v")[6] > 0, V.encrypt_payload("cut", KEY_HEX))
        .otherwise(F.col("cut"))
    )
    return rows.withColumn("raw", raw).withColumn("cut", cut).withColumn("vector", sealed)


@query(
    "s1_live_embeddings",
    """SELECT g.id, g.person_id, g.model, g.dim FROM gallery g JOIN people p ON p.id = g.person_id
       WHERE g.is_active AND p.status = 'active' AND g.pipeline = 'custom' AND g.model = 'm_new'""",
)
def s1(spark, sf_dir):
    live = live_embeddings(tables.gallery(spark, sf_dir), tables.people(spark, sf_dir), "custom", "m_new")
    return live.select("id", "person_id", "model", "dim")


@query(
    "v1_decrypt_payload",
    """SELECT id, model = 'm_old' AS lost,
              CASE WHEN model <> 'm_old' THEN CASE WHEN v[6] > 0.1875 THEN 255 ELSE 256 END END AS bytes
       FROM gallery""",
)
def v1(spark, sf_dir):
    rows = payloads(spark, sf_dir).withColumn("plain", V.decrypt_payload("vector", KEY_HEX))
    return rows.select("id", F.col("plain").isNull().alias("lost"), F.octet_length("plain").alias("bytes"))


@query(
    "v2_encrypt_payload",
    "SELECT id, 288 AS bytes, true AS prefixed, true AS same FROM gallery",
)
def v2(spark, sf_dir):
    rows = tables.gallery(spark, sf_dir).withColumn("raw", V.encode_vector(F.col("v").cast("array<float>")))
    sealed = rows.withColumn("sealed", V.encrypt_payload("raw", KEY_HEX))
    return sealed.select(
        "id",
        F.octet_length("sealed").alias("bytes"),
        V.is_encrypted("sealed").alias("prefixed"),
        (V.decrypt_payload("sealed", KEY_HEX) == F.col("raw")).alias("same"),
    )


@query(
    "v3_decode_vector",
    """SELECT id, CASE WHEN v[6] <= 0.1875 THEN 64 END AS dim,
              CASE WHEN v[6] <= 0.1875 THEN round(list_sum(v), 6) END AS total
       FROM gallery""",
)
def v3(spark, sf_dir):
    decoded = payloads(spark, sf_dir).withColumn("w", V.doubles(V.decode_vector("cut", DIM)))
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x)
    return decoded.select(
        "id", F.when(F.col("w").isNotNull(), F.size("w")).alias("dim"), F.round(total, 6).alias("total")
    )


@query("v4_encode_vector", "SELECT id, 256 AS bytes, round(v[1], 6) AS first FROM gallery")
def v4(spark, sf_dir):
    rows = tables.gallery(spark, sf_dir).withColumn("raw", V.encode_vector(F.col("v").cast("array<float>")))
    first = V.doubles(V.decode_vector(F.substring("raw", 1, 4), 1))[0]
    return rows.select("id", F.octet_length("raw").alias("bytes"), F.round(first, 6).alias("first"))


@query(
    "v5_validate_vectors",
    """SELECT CASE WHEN model = 'm_old' THEN 'undecodable' WHEN v[6] > 0.1875 THEN 'undecodable'
                   ELSE 'ok' END AS reason, count(*) AS rows
       FROM gallery GROUP BY reason""",
)
def v5(spark, sf_dir):
    decoded = payloads(spark, sf_dir).withColumn("w", V.decode_vector(V.decrypt_payload("vector", KEY_HEX), DIM))
    return vt.validation_summary(vt.validate_vectors(decoded, DIM, "w"))


@query(
    "v6_l2_normalize",
    f"""SELECT vec_id, round({length(unit('v'))}, 6) AS norm, round(({unit('v')})[1], 6) AS first FROM blends""",
)
def v6(spark, sf_dir):
    rows = tables.blends(spark, sf_dir).withColumn("u", V.l2_normalize("v"))
    return rows.select("vec_id", F.round(V.norm("u"), 6).alias("norm"), F.round(F.col("u")[0], 6).alias("first"))


@query(
    "v7_cosine_distance",
    f"""SELECT a.vec_id, round({inner('a.v', 'b.v')}, 6) AS dot, round({cos('a.v', 'b.v')}, 6) AS cosine,
               round(1 - {cos('a.v', 'b.v')}, 6) AS distance, round(list_distance(a.v, b.v), 6) AS l2
        FROM vec a JOIN blends b USING (vec_id)""",
)
def v7(spark, sf_dir):
    second = tables.blends(spark, sf_dir).select("vec_id", F.col("v").alias("w"))
    joined = tables.vectors(spark, sf_dir).join(second, "vec_id")
    measures = {"dot": V.dot, "cosine": V.cosine, "distance": V.cosine_distance, "l2": V.l2_distance}
    return joined.select("vec_id", *[F.round(f("v", "w"), 6).alias(name) for name, f in measures.items()])


@query(
    "v8_combine_views",
    f"""SELECT label, round(list_sum(u), 6) AS total, round(u[1], 6) AS first, round({length('u')}, 6) AS norm
        FROM (SELECT label, {unit('s')} AS u FROM (
            SELECT label, list(x ORDER BY pos) AS s FROM (
                SELECT label, pos, sum(x) AS x FROM (
                    SELECT label, unnest(range(1, len(v) + 1)) AS pos, unnest({unit('v')}) AS x FROM blends)
                GROUP BY label, pos) GROUP BY label))""",
)
def v8(spark, sf_dir):
    merged = sim.combine_views(tables.blends(spark, sf_dir), "label", "v")
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return merged.select(
        "label", F.round(total, 6).alias("total"), F.round(F.col("v")[0], 6).alias("first"), F.round(V.norm("v"), 6).alias("norm")
    )


@query(
    "v9_parity_check",
    f"""SELECT *, abs(norm_a - 1) <= 0.001 AS norm_ok,
               dim_ok AND max_abs_diff < 0.0001 AND l2_diff <= 0.00001 AND abs(norm_a - 1) <= 0.001 AS passed
        FROM (SELECT a.vec_id, len(a.v) = 64 AS dim_ok,
                     round(list_max(list_transform(range(1, 65), lambda i: abs(a.v[i] - b.v[i]))), 6) AS max_abs_diff,
                     round(list_distance(a.v, b.v), 6) AS l2_diff, round({length('a.v')}, 6) AS norm_a
              FROM vec a JOIN (SELECT vec_id, CASE WHEN v[1] >= 0 THEN v ELSE list_reverse(v) END AS v FROM vec) b
              USING (vec_id))""",
)
def v9(spark, sf_dir):
    base = tables.vectors(spark, sf_dir)
    other = base.withColumn("v", F.when(F.col("v")[0] >= 0, F.col("v")).otherwise(F.reverse("v")))
    return vt.parity_check(base, other, "vec_id", DIM)


@query(
    "v10_agreement_loss",
    f"""SELECT count(*) AS pairs, round(1 - avg({cos('s.v', 't.v')}), 6) AS loss
        FROM blends s JOIN views t ON t.key = s.vec_id * 2 AND t.status = 'ok'""",
)
def v10(spark, sf_dir):
    teacher = tables.views(spark, sf_dir)
    student = tables.blends(spark, sf_dir).select((F.col("vec_id") * 2).alias("key"), "v")
    return vt.agreement_loss(student, teacher, "key")


@query(
    "v11_uuid5",
    """SELECT c_custkey AS id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
              substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' ||
              substr(h, 21, 12) AS uuid
       FROM (SELECT c_custkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') ||
                                    encode('subject:' || c_mktsegment || ':' || c_name)) AS h FROM customer)""",
)
def v11(spark, sf_dir):
    rows = tables.read(spark, sf_dir, "customer")
    return rows.select(F.col("c_custkey").alias("id"), V.uuid5(F.lit("subject"), "c_mktsegment", "c_name").alias("uuid"))


@query(
    "v12_memory_estimate",
    """SELECT 'flat' AS index_type, pipeline, model, count(*) AS vectors, count(*) * 2048 AS memory_bytes
       FROM templates GROUP BY pipeline, model
       UNION ALL SELECT 'hnsw', pipeline, model, count(*), count(*) * (2048 + 512) FROM templates GROUP BY pipeline, model
       UNION ALL SELECT 'ivfpq', pipeline, model, count(*), count(*) * 32 FROM templates GROUP BY pipeline, model""",
)
def v12(spark, sf_dir):
    rows = tables.templates(spark, sf_dir)
    kinds = {"flat": {}, "hnsw": {"m": 32}, "ivfpq": {"m": 32, "nbits": 8}}
    parts = [
        vt.memory_estimate(rows, kind, params).select(F.lit(kind).alias("index_type"), "*") for kind, params in kinds.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


TOPK_SQL = f"""
    SELECT probe_id, id, score, round(1 - score, 6) AS distance, rank FROM (
        SELECT p.probe_id, g.id, round({cos('p.v', 'g.v')}, 6) AS score,
               row_number() OVER (PARTITION BY p.probe_id ORDER BY round({cos('p.v', 'g.v')}, 6) DESC, g.id) AS rank
        FROM probes p CROSS JOIN vec_gallery g)
    WHERE rank <= 10"""
VEC_GALLERY = {"vec_gallery": "SELECT vec_id AS id, v FROM vec"}


def probe_rows(spark, sf_dir):
    return sim.as_probes(tables.probes(spark, sf_dir), "v", "probe_id")


def gallery_rows(spark, sf_dir):
    return sim.as_gallery(tables.read(spark, sf_dir, "embeddings"), "embedding", "vec_id")


@query("j1_topk_exact", TOPK_SQL, extra=VEC_GALLERY)
def j1(spark, sf_dir):
    return sim.topk_exact(probe_rows(spark, sf_dir), gallery_rows(spark, sf_dir), 10)


@query("j2_topk_blocked", TOPK_SQL, extra=VEC_GALLERY)
def j2(spark, sf_dir):
    return sim.topk_blocked(probe_rows(spark, sf_dir), gallery_rows(spark, sf_dir), 10, block_rows=1024)


# a dozen vectors with others around them: most blocks can't hold a neighbour
ANCHORS = 12


def around_anchors(spark, sf_dir, key: str, anchor: int, shift: int, other: int) -> DataFrame:
    """``(key, v)``: an anchor and two fifths of another vector."""
    base = tables.vectors(spark, sf_dir)
    n = base.agg(F.count(F.lit(1))).scalar()
    centre = base.where(F.col("vec_id") < ANCHORS).select(F.col("vec_id").alias("_a"), F.col("v").alias("_c"))
    rest = base.select(F.col("vec_id").alias("_o"), F.col("v").alias("_r"))
    rows = base.select(
        F.col("vec_id").alias(key),
        ((F.col("vec_id") * anchor + shift) % ANCHORS).alias("_a"),
        ((F.col("vec_id") * other + shift) % n).alias("_o"),
    )
    return rows.join(F.broadcast(centre), "_a").join(rest, "_o").select(key, F.zip_with("_c", "_r", lambda c, r: c + 0.4 * r).alias("v"))


def around_sql(key: str, anchor: int, shift: int, other: int) -> str:
    return f"""
        SELECT x.vec_id AS {key}, list_transform(range(1, len(c.v) + 1), lambda i: c.v[i] + 0.4::DOUBLE * r.v[i]) AS v
        FROM vec x CROSS JOIN size_of JOIN vec c ON c.vec_id = (x.vec_id * {anchor} + {shift}) % {ANCHORS}
        JOIN vec r ON r.vec_id = (x.vec_id * {other} + {shift}) % n"""


NEAR_GALLERY, NEAR_PROBES = ("id", 1, 0, 1), ("probe_id", 5, 1, 7)


@query(
    "j2_topk_bounded",
    TOPK_SQL.replace("FROM probes p CROSS JOIN vec_gallery g", "FROM near_probes p CROSS JOIN near_gallery g"),
    extra={"near_gallery": around_sql(*NEAR_GALLERY), "near_probes": around_sql(*NEAR_PROBES)},
)
def j2_bounded(spark, sf_dir):
    probes, gallery = around_anchors(spark, sf_dir, *NEAR_PROBES), around_anchors(spark, sf_dir, *NEAR_GALLERY)
    return sim.topk_bounded(probes, gallery, 10, block_rows=16)


@query("j2_block_report")
def j2_report(spark, sf_dir):
    probes, gallery = around_anchors(spark, sf_dir, *NEAR_PROBES), around_anchors(spark, sf_dir, *NEAR_GALLERY)
    return sim.block_report(probes, gallery, 10, block_rows=16)


def cell_index(spark, sf_dir, nlist: int = 16) -> ann.CellIndex:
    return ann.ivf_build(gallery_rows(spark, sf_dir), nlist)


# with every cell probed the answer is the exact one
@query("j3_ivf_search_all_cells", TOPK_SQL, extra=VEC_GALLERY)
def j3_all(spark, sf_dir):
    return ann.ivf_search(probe_rows(spark, sf_dir), cell_index(spark, sf_dir), 10, nprobe=16)


@query("j3_ivf_search")
def j3(spark, sf_dir):
    return ann.ivf_search(probe_rows(spark, sf_dir), cell_index(spark, sf_dir), 10, nprobe=4)


@query("j3_ivf_build")
def j3_build(spark, sf_dir):
    return cell_index(spark, sf_dir).assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("vectors"))


@query("j4_pq_search")
def j4(spark, sf_dir):
    gallery = gallery_rows(spark, sf_dir)
    books = ann.pq_train(gallery, parts=8, bits=4)
    return ann.pq_search(probe_rows(spark, sf_dir), cell_index(spark, sf_dir), books, 10, nprobe=8)


@query("j4_pq_search_rescored")
def j4_rescored(spark, sf_dir):
    gallery = gallery_rows(spark, sf_dir)
    books = ann.pq_train(gallery, parts=8, bits=4)
    index = cell_index(spark, sf_dir)
    return ann.pq_search(probe_rows(spark, sf_dir), index, books, 10, nprobe=16, rescore_from=gallery)


# given centroids make cells, codes and scores plain SQL: the first vectors by id
GIVEN, PARTS = 16, 8


def best_cells(rows: str, key: str, n: int) -> str:
    return f"""
        SELECT {key}, v, cell FROM (
            SELECT r.{key}, r.v, c.cell, row_number() OVER (PARTITION BY r.{key} ORDER BY {inner('r.v', 'c.c')} DESC, c.cell) AS place
            FROM {rows} r CROSS JOIN centroids c)
        WHERE place <= {n}"""


def ranked(score: str, gallery: str, k: int) -> str:
    return f"""
        SELECT probe_id, id, score, round(1 - score, 6) AS distance, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, id) AS rank FROM (
                SELECT p.probe_id, g.id, round({score}, 6) AS score FROM probed p JOIN {gallery} g USING (cell)))
        WHERE rank <= {k}"""


def given_cells(nprobe: int) -> dict[str, str]:
    return {
        **VEC_GALLERY,
        "centroids": f"""
            SELECT row_number() OVER (ORDER BY id) - 1 AS cell, {unit('v')} AS c FROM vec_gallery ORDER BY id LIMIT {GIVEN}""",
        "cell_of": best_cells("vec_gallery", "id", 1),
        "probed": best_cells("probes", "probe_id", nprobe),
    }


def given_codes(nprobe: int) -> dict[str, str]:
    def piece(of: str) -> str:
        return f"{of}[len({of}) // {PARTS} * part + 1 : len({of}) // {PARTS} * (part + 1)]"

    return {
        **given_cells(nprobe),
        "part_numbers": f"SELECT unnest(range({PARTS})) AS part",
        "books": f"SELECT part, cell AS code, {piece('c')} AS b FROM centroids CROSS JOIN part_numbers",
        "pieces": f"SELECT id, cell, part, {piece('u')} AS x FROM (SELECT id, cell, {unit('v')} AS u FROM cell_of) CROSS JOIN part_numbers",
        "codes": f"""
            SELECT id, cell, part, b FROM (
                SELECT *, row_number() OVER (PARTITION BY id, part ORDER BY {inner('b', 'b')} / 2 - {inner('x', 'b')}, code) AS place
                FROM pieces JOIN books USING (part))
            WHERE place = 1""",
        "coded": "SELECT id, cell, flatten(list(b ORDER BY part)) AS v FROM codes GROUP BY id, cell",
        "unit_probed": f"SELECT probe_id, cell, {unit('v')} AS v FROM probed",
    }


def given_index(spark, sf_dir) -> ann.CellIndex:
    """An index over given centroids, written by cell and read back."""
    gallery = gallery_rows(spark, sf_dir)
    first = gallery.orderBy("id").limit(GIVEN).collect()
    index = ann.ivf_assign(gallery, np.array([row["v"] for row in sorted(first, key=lambda row: row["id"])]))
    path = f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4()}"
    write_index(index, path)
    return read_index(spark, path)


def given_books(index: ann.CellIndex) -> np.ndarray:
    return index.centroids.reshape(len(index.centroids), PARTS, -1).transpose(1, 0, 2)


@query("j3_ivf_search_given_cells", ranked(cos("p.v", "g.v"), "cell_of", 10), extra=given_cells(4))
def j3_given(spark, sf_dir):
    return ann.ivf_search(probe_rows(spark, sf_dir), given_index(spark, sf_dir), 10, nprobe=4, block_rows=64)


CODED_SQL = ranked(inner("p.v", "g.v"), "coded", 40).replace("FROM probed", "FROM unit_probed")


@query(
    "j4_pq_search_given_codes",
    f"SELECT * FROM ({CODED_SQL}) WHERE rank <= 10",
    extra=given_codes(8),
)
def j4_given(spark, sf_dir):
    index = given_index(spark, sf_dir)
    return ann.pq_search(probe_rows(spark, sf_dir), index, given_books(index), 10, nprobe=8)


@query(
    "j4_pq_search_given_codes_rescored",
    f"""
    SELECT probe_id, id, score, round(1 - score, 6) AS distance, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, id) AS rank FROM (
            SELECT s.probe_id, s.id, round({cos('p.v', 'g.v')}, 6) AS score
            FROM ({CODED_SQL}) s JOIN probes p USING (probe_id) JOIN vec_gallery g USING (id)))
    WHERE rank <= 10""",
    extra=given_codes(16),
)
def j4_given_rescored(spark, sf_dir):
    index, gallery = given_index(spark, sf_dir), gallery_rows(spark, sf_dir)
    return ann.pq_search(probe_rows(spark, sf_dir), index, given_books(index), 10, nprobe=16, rescore_from=gallery)


# residual codes: the books are what the next vectors by id differ from the centroids of their cells
def given_residuals(nprobe: int) -> dict[str, str]:
    def piece(of: str) -> str:
        return f"{of}[len({of}) // {PARTS} * part + 1 : len({of}) // {PARTS} * (part + 1)]"

    return {
        **given_cells(nprobe),
        "part_numbers": f"SELECT unnest(range({PARTS})) AS part",
        "rests": f"""
            SELECT id, cell, c, list_transform(range(1, len(u) + 1), lambda i: u[i] - c[i]) AS r
            FROM (SELECT id, cell, {unit('v')} AS u FROM cell_of) JOIN centroids USING (cell)""",
        "books": f"""
            SELECT part, n - {GIVEN + 1} AS code, {piece('r')} AS b
            FROM (SELECT *, row_number() OVER (ORDER BY id) AS n FROM rests) CROSS JOIN part_numbers
            WHERE n > {GIVEN} AND n <= 2 * {GIVEN}""",
        "pieces": f"SELECT id, part, {piece('r')} AS x FROM rests CROSS JOIN part_numbers",
        "codes": f"""
            SELECT id, part, b FROM (
                SELECT *, row_number() OVER (PARTITION BY id, part ORDER BY {inner('b', 'b')} / 2 - {inner('x', 'b')}, code) AS place
                FROM pieces JOIN books USING (part))
            WHERE place = 1""",
        "coded": """
            SELECT id, cell, list_transform(range(1, len(c) + 1), lambda i: c[i] + f[i]) AS v
            FROM rests JOIN (SELECT id, flatten(list(b ORDER BY part)) AS f FROM codes GROUP BY id) USING (id)""",
        "unit_probed": f"SELECT probe_id, cell, {unit('v')} AS v FROM probed",
    }


def stored_codes(spark, sf_dir) -> ann.CodeIndex:
    """Residual codes over given centroids and books, written by cell and read back."""
    gallery = gallery_rows(spark, sf_dir)
    first = sorted(gallery.orderBy("id").limit(2 * GIVEN).collect(), key=lambda row: row["id"])
    vectors = sim.unit_rows(np.array([row["v"] for row in first], np.float64))
    index = ann.ivf_assign(gallery, vectors[:GIVEN])
    rests = vectors[GIVEN:] - index.centroids[ann.best_cells(vectors[GIVEN:], index.centroids, 1)[:, 0]]
    books = rests.reshape(len(rests), PARTS, -1).transpose(1, 0, 2)
    path = f"{ensure_checkpoint_dir(spark)}/codes-{uuid.uuid4()}"
    write_codes(ann.code_index(index, books), path)
    return read_codes(spark, path)


@query(
    "j4_stored_codes",
    f"SELECT * FROM ({CODED_SQL}) WHERE rank <= 10",
    extra=given_residuals(8),
)
def j4_stored(spark, sf_dir):
    return ann.code_search(probe_rows(spark, sf_dir), stored_codes(spark, sf_dir), 10, nprobe=8, block_rows=64)


@query(
    "j4_stored_codes_rescored",
    f"""
    SELECT probe_id, id, score, round(1 - score, 6) AS distance, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, id) AS rank FROM (
            SELECT s.probe_id, s.id, round({cos('p.v', 'g.v')}, 6) AS score
            FROM ({CODED_SQL}) s JOIN probes p USING (probe_id) JOIN vec_gallery g USING (id)))
    WHERE rank <= 10""",
    extra=given_residuals(16),
)
def j4_stored_rescored(spark, sf_dir):
    index, gallery = stored_codes(spark, sf_dir), gallery_rows(spark, sf_dir)
    return ann.code_search(probe_rows(spark, sf_dir), index, 10, nprobe=16, rescore_from=gallery)


def recall_by_search(probes: DataFrame, gallery: DataFrame, searches: dict) -> DataFrame:
    """``search, k, overlap``: the share of the exact 1 and 10 best that each search finds."""
    names = [F.lit(name) for name in searches]
    exact = sim.topk_exact(probes, gallery, 10).withColumn("search", F.explode(F.array(*names)))
    found = None
    for name, search in searches.items():
        rows = search().withColumn("search", F.lit(name))
        found = rows if found is None else found.unionByName(rows)
    return topk_overlap(exact, found, (1, 10), ["search"])


@query("j3_j4_recall")
def j3_j4_recall(spark, sf_dir):
    """Recall of trained cells and trained residual codes against exact search."""
    # every search reads the probes, which are made by a join
    probes, gallery = durable(probe_rows(spark, sf_dir)), gallery_rows(spark, sf_dir)
    index = cell_index(spark, sf_dir)
    codes = ann.code_index(index, ann.code_train(index, parts=16, bits=6))
    searches = {f"cells_{n}": lambda n=n: ann.ivf_search(probes, index, 10, n) for n in (4, 8)}
    searches["codes_16"] = lambda: ann.code_search(probes, codes, 10, 16)
    searches["codes_16_rescored"] = lambda: ann.code_search(probes, codes, 10, 16, rescore_from=gallery, widen=10)
    return recall_by_search(probes, gallery, searches)


@query(
    "j5_rescore",
    f"""SELECT probe_id, id, round({cos('p.v', 'g.v')}, 6) AS score, round(1 - round({cos('p.v', 'g.v')}, 6), 6) AS distance
        FROM near JOIN probes p USING (probe_id) JOIN vec_gallery g USING (id)""",
    extra={
        **VEC_GALLERY,
        "near": """SELECT vec_id AS probe_id, vec_id AS id FROM vec
                   UNION SELECT a.vec_id, (a.vec_id * 7 + 3) % n FROM vec a CROSS JOIN size_of""",
    },
)
def j5(spark, sf_dir):
    base = tables.vectors(spark, sf_dir).select("vec_id")
    n = base.agg(F.count(F.lit(1))).scalar()
    own = base.select(F.col("vec_id").alias("probe_id"), F.col("vec_id").alias("id"))
    other = base.select(F.col("vec_id").alias("probe_id"), ((F.col("vec_id") * 7 + 3) % n).alias("id"))
    near = own.unionByName(other).distinct().withColumn("score", F.lit(0.0))
    return sim.rescore(near, probe_rows(spark, sf_dir), gallery_rows(spark, sf_dir))


@query(
    "j8_score_pairs",
    "SELECT pair_id, label_same, pipeline, score, status, error FROM pair_rows",
)
def j8(spark, sf_dir):
    rows = sim.score_pairs(tables.pairs(spark, sf_dir), tables.views(spark, sf_dir))
    return rows.select("pair_id", "label_same", "pipeline", "score", "status", "error")


@query(
    "j11_centroid_accuracy",
    f"""SELECT count(*) AS items, count(*) FILTER (WHERE predicted = label) AS correct,
               round(avg((predicted = label)::INT), 6) AS accuracy
        FROM (SELECT b.vec_id, b.label, arg_min(c.label, struct_pack(s := -round({cos('b.v', 'c.s')}, 6), l := c.label)) AS predicted
              FROM blends b CROSS JOIN centroids c GROUP BY b.vec_id, b.label)""",
    extra={
        "centroids": f"""SELECT label, list(x ORDER BY pos) AS s FROM (
                SELECT label, pos, sum(x) AS x FROM (
                    SELECT label, unnest(range(1, len(v) + 1)) AS pos, unnest({unit('v')}) AS x FROM blends)
                GROUP BY label, pos) GROUP BY label"""
    },
)
def j11(spark, sf_dir):
    return sim.centroid_accuracy(tables.blends(spark, sf_dir), "label", "v", "vec_id")


@query(
    "j12_similarity_profile",
    f"""SELECT *, identity = (SELECT identity FROM stats ORDER BY avg_score DESC, identity LIMIT 1) AS is_best FROM stats""",
    extra={
        "stats": f"""SELECT label AS identity, count(*) AS items, round(avg({cos('v', 'p')}), 6) AS avg_score,
                            round(max({cos('v', 'p')}), 6) AS max_score, round(min({cos('v', 'p')}), 6) AS min_score
                     FROM blends CROSS JOIN (SELECT v AS p FROM vec ORDER BY vec_id LIMIT 1) GROUP BY label"""
    },
)
def j12(spark, sf_dir):
    probe = tables.vectors(spark, sf_dir).orderBy("vec_id").limit(1)
    return sim.similarity_profile(probe, tables.blends(spark, sf_dir).withColumnRenamed("label", "identity"))
