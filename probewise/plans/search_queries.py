"""Registered queries from candidates to identity decisions and their metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probewise.functions.labels import threshold_for
from probewise.operators import approximate as ann
from probewise.operators import benchmark as bench
from probewise.operators import decisions as dec
from probewise.operators import retrieval as ret
from probewise.operators import similarity as sim
from probewise.plans import tables
from probewise.plans.flows import ImageSearch
from probewise.plans.registry import query
from probewise.plans.sql_tables import cos, inner, unit
from probewise.plans.vector_queries import gallery_rows, probe_rows
from probewise.session import durable

# fixed values: the calibrated threshold of the custom space and the default one of the other
THRESHOLD, OTHER_THRESHOLD = 0.205047, 0.4
FAST, SAFE, K = 20, 60, 5
# cells of each space, those of the fast pass and those of both passes
CELLS, FAST_CELLS, SAFE_CELLS = 8, 2, 6


def stages(spark, sf_dir) -> ImageSearch:
    return ImageSearch(
        tables.probes(spark, sf_dir),
        tables.gallery(spark, sf_dir),
        tables.people(spark, sf_dir),
        "custom",
        THRESHOLD,
        K,
        k_fast=FAST,
        k_safe=SAFE,
    )


CHAIN = {
    "space_rows": "SELECT id, v, person_id, is_active FROM gallery WHERE pipeline = 'custom'",
    "all_ranked": f"""
        SELECT probe_id, id, score, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, id) AS rank
        FROM (SELECT p.probe_id, g.id, round({cos('p.v', 'g.v')}, 6) AS score FROM probes p CROSS JOIN space_rows g)""",
    "fast_best": "SELECT probe_id, max(score) AS best FROM all_ranked GROUP BY probe_id",
    "info": f"""
        SELECT p.probe_id, p.image_id, p.face_index, best AS best_score,
               CASE WHEN best IS NULL THEN 'fast' WHEN best < {THRESHOLD} + 0.05 THEN 'safe_fallback' ELSE 'fast' END AS search_mode,
               CASE WHEN best IS NULL THEN {FAST} WHEN best < {THRESHOLD} + 0.05 THEN {SAFE} ELSE {FAST} END AS candidate_k,
               CASE WHEN best < {THRESHOLD} THEN 'below_threshold' WHEN best < {THRESHOLD} + 0.05 THEN 'near_threshold' END AS fallback_reason
        FROM probes p LEFT JOIN fast_best USING (probe_id)""",
    "candidates": "SELECT r.* FROM all_ranked r JOIN info i USING (probe_id) WHERE r.rank <= i.candidate_k",
    "hydrated": """
        SELECT c.probe_id, c.id, c.score, i.image_id, i.face_index, g.person_id, s.label
        FROM candidates c JOIN info i USING (probe_id) JOIN space_rows g USING (id) JOIN people s ON s.id = g.person_id
        WHERE g.is_active AND s.status = 'active'""",
    "identities": f"""
        SELECT image_id, face_index, probe_id, person_id, label, max(score) AS score,
               arg_min(id, struct_pack(s := -score, i := id)) AS embedding_id,
               count(*) FILTER (WHERE score >= greatest(0.18, round({THRESHOLD} - 0.06, 6))) AS support_count
        FROM hydrated GROUP BY ALL""",
    "gated": f"""
        SELECT * FROM identities JOIN (SELECT image_id, count(*) > 1 AS multi FROM probes GROUP BY image_id) USING (image_id)
        WHERE score >= {THRESHOLD} AND CASE WHEN multi THEN score >= 0.38 OR (score >= 0.34 AND support_count >= 2)
              ELSE score >= 0.36 OR (score >= 0.32 AND support_count >= 2) OR (score >= 0.30 AND support_count >= 4) END""",
    "gated_ranks": """
        SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS s2, lead(support_count) OVER w AS c2
        FROM gated WINDOW w AS (PARTITION BY probe_id ORDER BY score DESC, support_count DESC, person_id)""",
    "ambiguous": """
        SELECT probe_id FROM gated_ranks WHERE rank = 1 AND s2 IS NOT NULL AND CASE WHEN multi
               THEN (score < 0.38 AND round(score - s2, 6) < 0.08) OR (support_count <= c2 AND round(score - s2, 6) < 0.06)
               ELSE (score < 0.34 AND round(score - s2, 6) < 0.05) OR (support_count <= c2 AND round(score - s2, 6) < 0.035) END""",
    "ranked": f"SELECT * FROM gated_ranks WHERE rank <= {K} AND probe_id NOT IN (SELECT probe_id FROM ambiguous)",
    "results": """
        SELECT * FROM (SELECT *, row_number() OVER (
                PARTITION BY image_id, coalesce(lower(trim(label)), person_id::VARCHAR)
                ORDER BY score DESC, support_count DESC, face_index, rank) AS pick FROM ranked)
        WHERE pick = 1""",
}
IDENTITY = ["image_id", "face_index", "probe_id", "person_id", "label", "score", "embedding_id", "support_count"]
IDENTITY_LIST = ", ".join(IDENTITY)


@query(
    "j6_search_dynamic",
    "SELECT probe_id, best_score, search_mode, candidate_k, fallback_reason FROM info",
    extra=CHAIN,
)
def j6(spark, sf_dir):
    return stages(spark, sf_dir).probe_info.drop("image_id", "face_index")


@query("j7_hydrate", "SELECT probe_id, id, person_id, label, score FROM hydrated", extra=CHAIN)
def j7(spark, sf_dir):
    found = stages(spark, sf_dir).scored
    return found.select("probe_id", "id", "person_id", "label", "score")


@query("d1_aggregate_identities", f"SELECT {IDENTITY_LIST} FROM identities", extra=CHAIN)
def d1(spark, sf_dir):
    return stages(spark, sf_dir).identities.select(*IDENTITY)


@query("d2_supported", f"SELECT {IDENTITY_LIST}, multi FROM gated", extra=CHAIN)
def d2(spark, sf_dir):
    return stages(spark, sf_dir).gated.select(*IDENTITY, "multi")


@query(
    "d3_reject_ambiguous",
    f"SELECT {IDENTITY_LIST} FROM gated WHERE probe_id NOT IN (SELECT probe_id FROM ambiguous)",
    extra=CHAIN,
)
def d3(spark, sf_dir):
    return dec.reject_ambiguous(stages(spark, sf_dir).gated).select(*IDENTITY)


@query("d4_rank_identities", f"SELECT {IDENTITY_LIST}, rank FROM ranked", extra=CHAIN)
def d4(spark, sf_dir):
    return stages(spark, sf_dir).ranked.select(*IDENTITY, "rank")


@query("d5_dedup_identities", f"SELECT {IDENTITY_LIST} FROM results", extra=CHAIN)
def d5(spark, sf_dir):
    return stages(spark, sf_dir).results.select(*IDENTITY)


@query(
    "d6_summarize_search",
    """SELECT i.image_id, i.faces_processed, coalesce(r.matched, 0) AS matched_faces,
              CASE WHEN r.matched > 0 THEN 'match' ELSE 'unknown' END AS decision,
              coalesce(r.best, i.best) AS best_score,
              CASE WHEN i.modes > 1 THEN 'mixed' ELSE i.mode END AS search_mode, i.candidate_k, i.fallback_reason
       FROM (SELECT image_id, count(*) AS faces_processed, max(best_score) AS best, count(DISTINCT search_mode) AS modes,
                    min(search_mode) AS mode, max(candidate_k) AS candidate_k,
                    string_agg(DISTINCT fallback_reason, ', ' ORDER BY fallback_reason) AS fallback_reason
             FROM info GROUP BY image_id) i
       LEFT JOIN (SELECT image_id, count(DISTINCT face_index) AS matched, max(score) AS best
                  FROM results GROUP BY image_id) r USING (image_id)""",
    extra=CHAIN,
)
def d6(spark, sf_dir):
    return stages(spark, sf_dir).summary


@query(
    "p9_annotate_detections",
    f"""SELECT image_id, face_index, coalesce(b.label, 'No match') AS label, b.score,
              CASE WHEN b.score >= 0.3 THEN 'match' WHEN b.score >= greatest(0.2, 0.21) THEN 'weak' ELSE 'unknown' END AS quality
       FROM probes LEFT JOIN (
           SELECT image_id, face_index, max(score) AS score,
                  arg_min(label, struct_pack(s := -score, p := person_id, l := label)) AS label
           FROM identities GROUP BY image_id, face_index) b USING (image_id, face_index)""",
    extra=CHAIN,
)
def p9(spark, sf_dir):
    named = stages(spark, sf_dir).identities.withColumn("threshold", F.lit(0.3))
    return dec.annotate_detections(named, tables.probes(spark, sf_dir))


def cell_stages(spark, sf_dir) -> list[ImageSearch]:
    """The search of both spaces over cells of given centroids, the first vectors of each space by id."""
    gallery, people = tables.gallery(spark, sf_dir), tables.people(spark, sf_dir)
    faces = tables.probes(spark, sf_dir)
    found = []
    for pipeline, threshold in (("custom", THRESHOLD), ("pretrained", OTHER_THRESHOLD)):
        space = sim.as_gallery(gallery.where(F.col("pipeline") == pipeline), "v", "id")
        first = sorted(space.orderBy("id").limit(CELLS).collect(), key=lambda row: row["id"])
        index = ann.ivf_assign(space, np.array([row["v"] for row in first]))
        widths = {"k_fast": FAST, "k_safe": SAFE, "nprobe_fast": FAST_CELLS, "nprobe_safe": SAFE_CELLS}
        found.append(ImageSearch(faces, gallery, people, pipeline, threshold, K, search=ann.CellSearch(index), **widths))
    return found


def of_both(spark, sf_dir, pick) -> DataFrame:
    parts = [pick(stage).withColumn("pipeline", F.lit(stage.pipeline)) for stage in cell_stages(spark, sf_dir)]
    return parts[0].unionByName(parts[1])


CELL_CHAIN = {
    "spaces": f"""
        SELECT 'custom' AS pipeline, {THRESHOLD}::DOUBLE AS threshold UNION ALL SELECT 'pretrained', {OTHER_THRESHOLD}::DOUBLE""",
    "centroids": f"""
        SELECT pipeline, row_number() OVER (PARTITION BY pipeline ORDER BY id) - 1 AS cell, {unit('v')} AS c
        FROM gallery QUALIFY cell < {CELLS}""",
    "cell_of": f"""
        SELECT g.id, g.pipeline, g.v, g.person_id, g.is_active, c.cell FROM gallery g JOIN centroids c USING (pipeline)
        QUALIFY row_number() OVER (PARTITION BY g.pipeline, g.id ORDER BY {inner('g.v', 'c.c')} DESC, c.cell) = 1""",
    "probed": f"""
        SELECT c.pipeline, p.probe_id, p.v, c.cell,
               row_number() OVER (PARTITION BY c.pipeline, p.probe_id ORDER BY {inner('p.v', 'c.c')} DESC, c.cell) AS place
        FROM probes p CROSS JOIN centroids c QUALIFY place <= {SAFE_CELLS}""",
    "scores": f"""
        SELECT p.pipeline, p.probe_id, p.place, g.id, g.person_id, g.is_active, round({cos('p.v', 'g.v')}, 6) AS score
        FROM probed p JOIN cell_of g USING (pipeline, cell)""",
    "bests": f"""
        SELECT pipeline, probe_id, max(score) FILTER (WHERE place <= {FAST_CELLS}) AS fast_best, max(score) AS safe_best
        FROM scores GROUP BY ALL""",
    "judged": """
        SELECT s.pipeline, s.threshold, p.probe_id, p.image_id, p.face_index, fast_best, safe_best,
               CASE WHEN fast_best IS NULL THEN 'no_candidates' WHEN fast_best < threshold THEN 'below_threshold'
                    WHEN fast_best < threshold + 0.05 THEN 'near_threshold' END AS reason
        FROM probes p CROSS JOIN spaces s LEFT JOIN bests USING (pipeline, probe_id)""",
    "info": f"""
        SELECT pipeline, threshold, probe_id, image_id, face_index, CASE WHEN wide THEN safe_best ELSE fast_best END AS best_score,
               CASE WHEN wide THEN 'safe_fallback' ELSE 'fast' END AS search_mode,
               CASE WHEN wide THEN {SAFE} ELSE {FAST} END AS candidate_k, CASE WHEN wide THEN reason END AS fallback_reason
        FROM (SELECT *, reason IS NOT NULL AND safe_best IS NOT NULL AND safe_best >= coalesce(fast_best, -2) AS wide FROM judged)""",
    "candidates": f"""
        SELECT s.*, i.image_id, i.face_index, i.threshold FROM scores s JOIN info i USING (pipeline, probe_id)
        WHERE s.place <= CASE i.search_mode WHEN 'fast' THEN {FAST_CELLS} ELSE {SAFE_CELLS} END
        QUALIFY row_number() OVER (PARTITION BY s.pipeline, s.probe_id ORDER BY s.score DESC, s.id) <= i.candidate_k""",
    "hydrated": """
        SELECT c.*, s.label FROM candidates c JOIN people s ON s.id = c.person_id WHERE c.is_active AND s.status = 'active'""",
    "identities": """
        SELECT pipeline, threshold, image_id, face_index, probe_id, person_id, label, max(score) AS score,
               arg_min(id, struct_pack(s := -score, i := id)) AS embedding_id,
               count(*) FILTER (WHERE score >= CASE pipeline WHEN 'custom' THEN greatest(0.18, round(threshold - 0.06, 6))
                                               ELSE threshold END) AS support_count
        FROM hydrated GROUP BY ALL""",
    "gated": """
        SELECT * FROM identities JOIN (SELECT image_id, count(*) > 1 AS multi FROM probes GROUP BY image_id) USING (image_id)
        WHERE score >= threshold AND CASE
            WHEN pipeline = 'custom' AND multi THEN score >= 0.38 OR (score >= 0.34 AND support_count >= 2)
            WHEN pipeline = 'custom' THEN score >= 0.36 OR (score >= 0.32 AND support_count >= 2) OR (score >= 0.30 AND support_count >= 4)
            WHEN multi THEN score >= 0.56 OR (score >= 0.50 AND support_count >= 2) OR (score >= 0.46 AND support_count >= 3)
            ELSE score >= 0.54 OR (score >= 0.46 AND support_count >= 2) OR (score >= 0.40 AND support_count >= 3) END""",
    "gated_ranks": """
        SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS s2, lead(support_count) OVER w AS c2
        FROM gated WINDOW w AS (PARTITION BY pipeline, probe_id ORDER BY score DESC, support_count DESC, person_id)""",
    "ambiguous": """
        SELECT pipeline, probe_id FROM gated_ranks WHERE rank = 1 AND s2 IS NOT NULL AND CASE
            WHEN pipeline = 'custom' AND multi
                THEN (score < 0.38 AND round(score - s2, 6) < 0.08) OR (support_count <= c2 AND round(score - s2, 6) < 0.06)
            WHEN pipeline = 'custom'
                THEN (score < 0.34 AND round(score - s2, 6) < 0.05) OR (support_count <= c2 AND round(score - s2, 6) < 0.035)
            WHEN multi THEN score < 0.56 AND round(score - s2, 6) < 0.07
            ELSE score < 0.50 AND round(score - s2, 6) < 0.055 END""",
    "ranked": f"SELECT * FROM gated_ranks ANTI JOIN ambiguous USING (pipeline, probe_id) WHERE rank <= {K}",
    "results": """
        SELECT * FROM ranked QUALIFY row_number() OVER (
            PARTITION BY pipeline, image_id, coalesce(lower(trim(label)), person_id::VARCHAR)
            ORDER BY score DESC, support_count DESC, face_index, rank) = 1""",
}
SPACED = ["pipeline", *IDENTITY]
SPACED_LIST = ", ".join(SPACED)


@query(
    "j6_cells_dynamic",
    """SELECT pipeline, probe_id, best_score, search_mode, candidate_k, fallback_reason FROM info""",
    extra=CELL_CHAIN,
)
def j6_cells(spark, sf_dir):
    return of_both(spark, sf_dir, lambda stage: stage.probe_info.drop("image_id", "face_index"))


# how often each reason led to the wide pass and how often that found a better row
@query(
    "j6_cells_gain",
    """SELECT pipeline, reason, count(*) AS probes, count(*) FILTER (WHERE safe_best > coalesce(fast_best, -2)) AS better
       FROM judged WHERE reason IS NOT NULL GROUP BY ALL""",
    extra=CELL_CHAIN,
)
def j6_gain(spark, sf_dir):
    def gain(stage: ImageSearch) -> DataFrame:
        fast = stage.search(stage.probes, 1, FAST_CELLS).select("probe_id", F.col("score").alias("fast_best"))
        joined = stage.probe_info.join(fast, "probe_id", "left").where("search_mode = 'safe_fallback'")
        better = F.count_if(F.col("best_score") > F.coalesce("fast_best", F.lit(-2.0)))
        return joined.groupBy(F.col("fallback_reason").alias("reason")).agg(F.count(F.lit(1)).alias("probes"), better.alias("better"))

    return of_both(spark, sf_dir, gain)


@query("j7_cells_hydrate", "SELECT pipeline, probe_id, id, person_id, label, score FROM hydrated", extra=CELL_CHAIN)
def j7_cells(spark, sf_dir):
    return of_both(spark, sf_dir, lambda stage: stage.scored.select("probe_id", "id", "person_id", "label", "score"))


@query("d1_cells_identities", f"SELECT {SPACED_LIST} FROM identities", extra=CELL_CHAIN)
def d1_cells(spark, sf_dir):
    return of_both(spark, sf_dir, lambda stage: stage.identities.select(*IDENTITY))


@query("d2_cells_supported", f"SELECT {SPACED_LIST}, multi FROM gated", extra=CELL_CHAIN)
def d2_cells(spark, sf_dir):
    return of_both(spark, sf_dir, lambda stage: stage.gated.select(*IDENTITY, "multi"))


@query(
    "d3_cells_reject_ambiguous",
    f"SELECT {SPACED_LIST} FROM gated ANTI JOIN ambiguous USING (pipeline, probe_id)",
    extra=CELL_CHAIN,
)
def d3_cells(spark, sf_dir):
    return of_both(spark, sf_dir, lambda stage: dec.reject_ambiguous(stage.gated).select(*IDENTITY))


@query("d4_cells_rank", f"SELECT {SPACED_LIST}, rank FROM ranked", extra=CELL_CHAIN)
def d4_cells(spark, sf_dir):
    return of_both(spark, sf_dir, lambda stage: stage.ranked.select(*IDENTITY, "rank"))


@query("d5_cells_dedup", f"SELECT {SPACED_LIST} FROM results", extra=CELL_CHAIN)
def d5_cells(spark, sf_dir):
    return of_both(spark, sf_dir, lambda stage: stage.results.select(*IDENTITY))


@query(
    "d6_cells_summary",
    """SELECT i.pipeline, i.image_id, i.faces_processed, coalesce(r.matched, 0) AS matched_faces,
              CASE WHEN r.matched > 0 THEN 'match' ELSE 'unknown' END AS decision,
              coalesce(r.best, i.best) AS best_score,
              CASE WHEN i.modes > 1 THEN 'mixed' ELSE i.mode END AS search_mode, i.candidate_k, i.fallback_reason
       FROM (SELECT pipeline, image_id, count(*) AS faces_processed, max(best_score) AS best, count(DISTINCT search_mode) AS modes,
                    min(search_mode) AS mode, max(candidate_k) AS candidate_k,
                    string_agg(DISTINCT fallback_reason, ', ' ORDER BY fallback_reason) AS fallback_reason
             FROM info GROUP BY ALL) i
       LEFT JOIN (SELECT pipeline, image_id, count(DISTINCT face_index) AS matched, max(score) AS best
                  FROM results GROUP BY ALL) r USING (pipeline, image_id)""",
    extra=CELL_CHAIN,
)
def d6_cells(spark, sf_dir):
    return of_both(spark, sf_dir, lambda stage: stage.summary)


@query(
    "p9_cells_annotate",
    """SELECT s.pipeline, p.image_id, p.face_index, coalesce(b.label, 'No match') AS label, b.score,
              CASE WHEN b.score >= s.threshold THEN 'match' WHEN b.score >= greatest(0.2, round(s.threshold * 0.7, 6)) THEN 'weak'
                   ELSE 'unknown' END AS quality
       FROM probes p CROSS JOIN spaces s LEFT JOIN (
           SELECT pipeline, image_id, face_index, max(score) AS score,
                  arg_min(label, struct_pack(s := -score, p := person_id, l := label)) AS label
           FROM identities GROUP BY ALL) b USING (pipeline, image_id, face_index)""",
    extra=CELL_CHAIN,
)
def p9_cells(spark, sf_dir):
    faces = tables.probes(spark, sf_dir)
    return of_both(spark, sf_dir, lambda stage: dec.annotate_detections(stage.identities, faces))


@query(
    "p10_threshold_for",
    """SELECT id, CASE WHEN pipeline = 'custom' AND is_active THEN 0.28 WHEN pipeline = 'custom' THEN 0.205047
                       ELSE 0.4 END::DOUBLE AS threshold
       FROM gallery""",
)
def p10(spark, sf_dir):
    settings = {"custom_live": 0.28, "custom": 0.205047, "pretrained": None, "default": 0.4}
    rows = tables.gallery(spark, sf_dir)
    return rows.select("id", threshold_for("pipeline", "is_active", settings).alias("threshold"))


EXACT = {
    "full_ranked": f"""
        SELECT probe_id, id, label, score, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, id) AS rank
        FROM (SELECT p.probe_id, g.vec_id AS id, g.label, round({cos('p.v', 'g.v')}, 6) AS score
              FROM probes p CROSS JOIN vec g)""",
    "half_ranked": f"""
        SELECT probe_id, id, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, id) AS rank
        FROM (SELECT p.probe_id, g.id, round({cos('p.v', 'g.v')}, 6) AS score
              FROM probes p CROSS JOIN gallery g WHERE g.pipeline = 'custom')""",
    "wanted": "SELECT unnest([1, 5, 10])::INT AS k",
}


# the other search sees one space only, so it misses the neighbours of the other
@query(
    "b1_topk_overlap",
    """SELECT k, round(count(h.id) / k / (SELECT count(*) FROM probes), 6) AS overlap
       FROM wanted JOIN full_ranked f ON f.rank <= k
       LEFT JOIN half_ranked h ON h.probe_id = f.probe_id AND h.id = f.id AND h.rank <= k GROUP BY k""",
    extra=EXACT,
)
def b1(spark, sf_dir):
    probes, gallery = probe_rows(spark, sf_dir), gallery_rows(spark, sf_dir)
    space = tables.gallery(spark, sf_dir).where("pipeline = 'custom'").select("id")
    exact = sim.topk_exact(probes, gallery, 10)
    other = sim.topk_exact(probes, gallery.join(space, "id", "left_semi"), 10)
    return ret.topk_overlap(exact, other)


def labelled_results(spark, sf_dir, k: int):
    found = sim.topk_exact(probe_rows(spark, sf_dir), gallery_rows(spark, sf_dir), k)
    labels = tables.vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "label")
    return found.join(labels, "id")


@query(
    "b2_recall_at_k",
    """SELECT count(*) AS queries, count(*) FILTER (WHERE hit) AS found, round(avg(hit::INT), 6) AS recall
       FROM (SELECT p.probe_id, coalesce(bool_or(f.label = p.label), false) AS hit
             FROM probes p LEFT JOIN full_ranked f ON f.probe_id = p.probe_id AND f.rank <= 5 GROUP BY p.probe_id)""",
    extra=EXACT,
)
def b2(spark, sf_dir):
    truth = tables.probes(spark, sf_dir).select("probe_id", "label")
    return ret.recall_at_k(labelled_results(spark, sf_dir, 5), truth, 5)


OUTCOMES = {
    **EXACT,
    "responses": """
        SELECT p.probe_id, 'L' || p.label AS expected, 'L' || f.label AS predicted, f.score,
               CASE WHEN f.score >= 0.3 THEN 'match' ELSE 'unknown' END AS decision,
               CASE WHEN p.v[8] > 0.5 THEN 500 ELSE 200 END AS status_code
        FROM probes p LEFT JOIN full_ranked f ON f.probe_id = p.probe_id AND f.rank = 1""",
    "outcomes": """
        SELECT *, CASE WHEN status_code <> 200 THEN 'error' WHEN decision <> 'match' OR predicted IS NULL THEN 'no_match'
                       WHEN predicted = expected THEN 'correct' ELSE 'false_match' END AS outcome
        FROM responses""",
}


def responses(spark, sf_dir):
    top = labelled_results(spark, sf_dir, 1).select("probe_id", F.concat(F.lit("L"), F.col("label")).alias("predicted"), "score")
    asked = tables.probes(spark, sf_dir).select(
        "probe_id",
        F.concat(F.lit("L"), F.col("label")).alias("expected"),
        F.when(F.col("v")[7] > 0.5, 500).otherwise(200).alias("status_code"),
    )
    decision = F.when(F.col("score") >= 0.3, "match").otherwise("unknown")
    return asked.join(top, "probe_id", "left").withColumn("decision", decision)


@query("b3_classify_outcomes", "SELECT probe_id, expected, predicted, outcome FROM outcomes", extra=OUTCOMES)
def b3(spark, sf_dir):
    return ret.classify_outcomes(responses(spark, sf_dir)).select("probe_id", "expected", "predicted", "outcome")


@query(
    "b4_identification_report",
    """SELECT expected, is_total, items, correct, false_match, no_match, errors, round(correct / items, 6) AS accuracy,
              round(false_match / items, 6) AS false_match_rate, round(no_match / items, 6) AS no_match_rate
       FROM (SELECT expected, grouping(expected)::INT AS is_total, count(*) AS items,
                    count(*) FILTER (WHERE outcome = 'correct') AS correct,
                    count(*) FILTER (WHERE outcome = 'false_match') AS false_match,
                    count(*) FILTER (WHERE outcome = 'no_match') AS no_match,
                    count(*) FILTER (WHERE outcome = 'error') AS errors
             FROM outcomes GROUP BY ROLLUP (expected))""",
    extra=OUTCOMES,
)
def b4(spark, sf_dir):
    report = ret.identification_report(ret.classify_outcomes(responses(spark, sf_dir)))
    return report.withColumn("is_total", F.col("is_total").cast("int"))


PERCENTILES = """
    SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50,
           round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99
    FROM events GROUP BY event_type"""


@query("b5_latency_summary", PERCENTILES)
def b5(spark, sf_dir):
    return ret.latency_summary(tables.read(spark, sf_dir, "events"), "value", ["event_type"])


@query(
    "b5_latency_nearest_rank",
    """SELECT count(*) AS n, round(avg(value), 3) AS mean, round(max(value) FILTER (WHERE pos = round_even((n - 1) * 0.5, 0)), 3) AS p50,
              round(max(value) FILTER (WHERE pos = round_even((n - 1) * 0.95, 0)), 3) AS p95,
              round(max(value) FILTER (WHERE pos = round_even((n - 1) * 0.99, 0)), 3) AS p99
       FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS pos, count(*) OVER () AS n FROM events)""",
)
def b5_nearest(spark, sf_dir):
    return ret.latency_summary(tables.read(spark, sf_dir, "events"), "value", method="nearest", digits=3)


@query(
    "b6_sample_queries",
    """SELECT id, label FROM (SELECT vec_id AS id, label, row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) AS n FROM vec)
       WHERE n <= 100""",
)
def b6(spark, sf_dir):
    rows = tables.vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "label")
    return ret.sample_queries(rows, 100, 42)


@query(
    "b7_self_match",
    f"""SELECT probe_id, id, score, rank, identity, probe_identity
        FROM (SELECT p.vec_id AS probe_id, g.vec_id AS id, g.label AS identity, p.label AS probe_identity,
                     round({cos('p.v', 'g.v')}, 6) AS score,
                     row_number() OVER (PARTITION BY p.vec_id ORDER BY round({cos('p.v', 'g.v')}, 6) DESC, g.vec_id) AS rank
              FROM vec p CROSS JOIN vec g) WHERE rank <= 5""",
)
def b7(spark, sf_dir):
    gallery = gallery_rows(spark, sf_dir)
    names = tables.vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("label").alias("identity"))
    return ret.self_match(gallery, None, 5, sim.topk_exact, names).drop("distance")


@query("b8_benchmark_grid")
def b8(spark, sf_dir):
    probes, gallery = probe_rows(spark, sf_dir), gallery_rows(spark, sf_dir)
    exact = sim.topk_exact(probes, gallery, 10)
    index = ann.ivf_build(gallery, 16)
    configs = {"flat": lambda: sim.topk_exact(probes, gallery, 10)}
    for nprobe in (1, 4, 16):
        configs[f"ivf_nprobe{nprobe}"] = lambda nprobe=nprobe: ann.ivf_search(probes, index, 10, nprobe)
    for parts in (7, 8):
        configs[f"pq_parts{parts}"] = lambda parts=parts: ann.pq_search(
            probes, index, ann.pq_train(gallery, parts, 4), 10, 16
        )
    note = ann.check_code_shape(64, gallery.count(), 16, 8, 4)
    return ret.benchmark_grid(exact, configs, notes={"pq_parts8": note})


# sizes by methods over given centroids, the first vectors by id; codes of seven parts can't be made
GRID_CELLS, GRID_NPROBES = 16, (1, 4, 16)
SIZED = {
    "sizes": "SELECT unnest([0.25, 0.5, 1.0])::DOUBLE AS share",
    "placed": "SELECT *, ('0x' || substr(md5(vec_id::VARCHAR), 1, 8))::BIGINT / 4294967296 AS place FROM vec",
    "centroids": f"""
        SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cell, {unit('v')} AS c FROM vec ORDER BY vec_id LIMIT {GRID_CELLS}""",
    "cell_of": f"""
        SELECT g.vec_id AS id, g.v, g.place, c.cell FROM placed g CROSS JOIN centroids c
        QUALIFY row_number() OVER (PARTITION BY g.vec_id ORDER BY {inner('g.v', 'c.c')} DESC, c.cell) = 1""",
    "probe_cells": f"""
        SELECT p.probe_id, c.cell, row_number() OVER (PARTITION BY p.probe_id ORDER BY {inner('p.v', 'c.c')} DESC, c.cell) AS nth
        FROM probes p CROSS JOIN centroids c""",
    "all_scores": f"SELECT p.probe_id, g.id, g.cell, g.place, round({cos('p.v', 'g.v')}, 6) AS score FROM probes p CROSS JOIN cell_of g",
    "tried": f"""
        SELECT 'flat' AS method, 1 AS nprobe, {GRID_CELLS} AS cells
        UNION ALL SELECT 'ivf_' || n, n, n FROM (SELECT unnest({list(GRID_NPROBES)}) AS n)""",
    "reached": """
        SELECT share, method, s.probe_id, s.id, score, row_number() OVER (PARTITION BY share, method, s.probe_id ORDER BY score DESC, s.id) AS rank
        FROM all_scores s JOIN sizes ON s.place < share JOIN probe_cells c ON c.probe_id = s.probe_id AND c.cell = s.cell
        JOIN tried ON c.nth <= cells""",
    "work": """
        SELECT share, method, p.probe_id, (SELECT count(*) FROM reached r WHERE r.share = s.share AND r.method = t.method AND r.probe_id = p.probe_id) AS n
        FROM probes p CROSS JOIN sizes s CROSS JOIN tried t""",
    "work_summary": """
        SELECT share, method, round(avg(n), 6) AS scanned_mean, round(quantile_cont(n::DOUBLE, 0.5), 6) AS scanned_p50,
               round(quantile_cont(n::DOUBLE, 0.95), 6) AS scanned_p95, round(quantile_cont(n::DOUBLE, 0.99), 6) AS scanned_p99
        FROM work GROUP BY ALL""",
    "shared": """
        SELECT e.share, t.method, count(*) FILTER (e.rank <= 1 AND f.rank <= 1) AS h1, count(*) FILTER (e.rank <= 5 AND f.rank <= 5) AS h5,
               count(*) FILTER (e.rank <= 10 AND f.rank <= 10) AS h10, (SELECT count(*) FROM probes) AS q
        FROM reached e CROSS JOIN tried t LEFT JOIN reached f ON f.share = e.share AND f.method = t.method AND f.probe_id = e.probe_id AND f.id = e.id
        WHERE e.method = 'flat' AND e.rank <= 10 GROUP BY ALL""",
}


def given_methods(spark, sf_dir) -> list[bench.Method]:
    gallery = gallery_rows(spark, sf_dir)
    first = sorted(gallery.orderBy("id").limit(GRID_CELLS).collect(), key=lambda row: row["id"])
    index = ann.ivf_assign(gallery, np.array([row["v"] for row in first]))
    cells = {"nlist": GRID_CELLS}
    return [
        bench.flat_method(gallery),
        *[bench.Method(f"ivf_{n}", "ivf", ann.CellSearch(index), n, cells) for n in GRID_NPROBES],
        bench.attempt("ivfpq_7", "ivfpq", lambda: ann.CellSearch(ann.code_index(index, ann.code_train(index, 7, 4))), 16),
    ]


@query(
    "b8_given_sizes",
    f"""
    SELECT s.share, (SELECT count(*) FROM placed WHERE place < s.share) AS vectors, t.method, t.nprobe, 'ok' AS status, '' AS error, '' AS notes,
           (SELECT count(*) FROM placed WHERE place < s.share) * 256 + CASE WHEN t.method = 'flat' THEN 0 ELSE {GRID_CELLS} * 256 END AS memory_bytes,
           scanned_mean, scanned_p50, scanned_p95, scanned_p99,
           round(h1 / q, 6) AS overlap_at_1, round(h5 / 5 / q, 6) AS overlap_at_5, round(h10 / 10 / q, 6) AS overlap_at_10
    FROM sizes s CROSS JOIN tried t JOIN work_summary USING (share, method) JOIN shared USING (share, method)
    UNION ALL
    SELECT share, (SELECT count(*) FROM placed WHERE place < share), 'ivfpq_7', 16, 'failed', 'dimension 64 cannot be split into 7 equal parts', '',
           NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
    FROM sizes""",
    extra=SIZED,
)
def b8_given(spark, sf_dir):
    return bench.benchmark_sizes(durable(probe_rows(spark, sf_dir)), gallery_rows(spark, sf_dir), given_methods(spark, sf_dir))[0]


@query("b8_trained_sizes")
def b8_trained(spark, sf_dir):
    """Trained cells and codes by size, with the seconds of each method's search."""
    probes, gallery = durable(probe_rows(spark, sf_dir)), gallery_rows(spark, sf_dir)
    index = ann.ivf_build(gallery, 16)
    codes = {"m": 16, "nbits": 4}
    methods = [
        bench.flat_method(gallery),
        *[bench.Method(f"ivf_{n}", "ivf", ann.CellSearch(index), n, {"nlist": 16}) for n in (4, 8)],
        bench.attempt("ivfpq_16", "ivfpq", lambda: ann.CellSearch(ann.code_index(index, ann.code_train(index, 16, 4))), 16, codes),
    ]
    rows, seconds = bench.benchmark_sizes(probes, gallery, methods)
    took = F.create_map(*[F.lit(x) for name, s in seconds.items() for x in (name, round(s, 3))])
    return rows.withColumn("search_seconds", took[F.col("method")])


# a run per nation: its customers' balances stand for the metrics of a model
METRICS = {
    "metrics": """
        SELECT n_nationkey AS run_order, n_name AS run, n_regionkey AS family, round(avg(c_acctbal) / 100000, 4) AS eer,
               CASE WHEN count(*) FILTER (WHERE c_acctbal < 0) > 0 THEN round(max(c_acctbal) / 12000, 3) END AS tar,
               round(1 - avg(c_acctbal) / 100000, 3) AS accuracy
        FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""",
}


def metrics(spark, sf_dir):
    joined = tables.read(spark, sf_dir, "nation").join(
        tables.read(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    mean = F.avg("c_acctbal")
    return joined.groupBy(
        F.col("n_nationkey").alias("run_order"), F.col("n_name").alias("run"), F.col("n_regionkey").alias("family")
    ).agg(
        F.round(mean / 100000, 4).alias("eer"),
        F.when(F.min("c_acctbal") < 0, F.round(F.max("c_acctbal") / 12000, 3)).alias("tar"),
        F.round(1 - mean / 100000, 3).alias("accuracy"),
    )


@query(
    "b9_leaderboard",
    """SELECT family, 'lowest_eer' AS criterion, arg_min(run, struct_pack(v := eer, o := run_order)) AS run, min(eer) AS value FROM metrics GROUP BY family
       UNION ALL SELECT family, 'highest_tar', arg_min(run, struct_pack(v := -coalesce(tar, -1), o := run_order)), max(coalesce(tar, -1)) FROM metrics GROUP BY family
       UNION ALL SELECT family, 'highest_accuracy', arg_min(run, struct_pack(v := -accuracy, o := run_order)), max(accuracy) FROM metrics GROUP BY family""",
    extra=METRICS,
)
def b9(spark, sf_dir):
    return ret.leaderboard(metrics(spark, sf_dir), ["family"])


@query(
    "b10_compare_metrics",
    """SELECT a.family, a.eer AS eer_a, b.eer AS eer_b, a.accuracy AS accuracy_a, b.accuracy AS accuracy_b,
              CASE WHEN a.eer < b.eer THEN 'lower' WHEN a.eer > b.eer THEN 'higher' WHEN a.eer = b.eer THEN 'same' END AS eer_verdict,
              CASE WHEN a.accuracy < b.accuracy THEN 'lower' WHEN a.accuracy > b.accuracy THEN 'higher'
                   WHEN a.accuracy = b.accuracy THEN 'same' END AS accuracy_verdict
       FROM (SELECT family, arg_min(eer, run_order) AS eer, arg_min(accuracy, run_order) AS accuracy FROM metrics GROUP BY family) a
       JOIN (SELECT family, arg_max(eer, run_order) AS eer, arg_max(accuracy, run_order) AS accuracy FROM metrics GROUP BY family) b
       USING (family)""",
    extra=METRICS,
)
def b10(spark, sf_dir):
    runs = metrics(spark, sf_dir)

    def edge(pick):
        return runs.groupBy("family").agg(pick("eer", "run_order").alias("eer"), pick("accuracy", "run_order").alias("accuracy"))

    return ret.compare_metrics(edge(F.min_by), edge(F.max_by), ["family"])


@query(
    "b11_target_check",
    """SELECT run, accuracy >= 0.95 AS accuracy_met, eer <= 0.07 AS eer_met, coalesce(tar >= 0.8, false) AS tar_met,
              accuracy >= 0.95 OR eer <= 0.07 OR coalesce(tar >= 0.8, false) AS strong_candidate
       FROM metrics""",
    extra=METRICS,
)
def b11(spark, sf_dir):
    return ret.target_check(metrics(spark, sf_dir)).select("run", "accuracy_met", "eer_met", "tar_met", "strong_candidate")
