"""The domain tables in SQL, for checking results with another engine."""

from __future__ import annotations

import re


def inner(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b})"


def length(a: str) -> str:
    return f"sqrt(list_inner_product({a}, {a}))"


def cos(a: str, b: str) -> str:
    return f"(list_inner_product({a}, {b}) / ({length(a)} * {length(b)}))"


def unit(a: str) -> str:
    return f"list_transform({a}, lambda x: x / {length(a)})"


TABLES = {
    "vec": "SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings",
    "size_of": "SELECT count(*) AS n FROM embeddings",
    "gallery": """
        SELECT vec_id AS id, label::BIGINT AS person_id,
               CASE WHEN v[1] >= 0 THEN 'custom' ELSE 'pretrained' END AS pipeline,
               CASE WHEN v[2] >= -0.125 THEN 'm_new' ELSE 'm_old' END AS model,
               len(v) AS dim, v, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(vec_id) AS created_at,
               v[3] > -0.1875 AS is_active
        FROM vec""",
    "people": """
        SELECT s_suppkey AS id, 'Subject_' || s_nationkey::VARCHAR AS label,
               CASE WHEN s_acctbal < 1000 THEN 'deleted' ELSE 'active' END AS status
        FROM supplier""",
    "blends": """
        SELECT a.vec_id, a.label,
               list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] + (1 + a.vec_id % 5) * b.v[i]) AS v
        FROM vec a CROSS JOIN size_of JOIN vec b ON b.vec_id = (a.vec_id * 7 + 3) % n""",
    "probes": """
        SELECT vec_id AS probe_id, vec_id // 3 AS image_id, vec_id % 3 AS face_index, label, v FROM blends""",
    "views": """
        SELECT vec_id * 2 AS key, v,
               CASE WHEN v[4] > 0.3125 THEN 'no_face' WHEN v[4] < -0.3125 THEN 'face_processing_error'
                    ELSE 'ok' END AS status
        FROM vec WHERE v[5] >= -0.3125
        UNION ALL SELECT vec_id * 2 + 1, v, 'ok' FROM blends""",
    "pairs": """
        SELECT vec_id * 2 + 1 AS pair_id, 1 AS label_same, vec_id * 2 AS key1, vec_id * 2 + 1 AS key2,
               CASE WHEN v[1] >= 0 THEN 'custom' ELSE 'pretrained' END AS pipeline
        FROM vec
        UNION ALL
        SELECT vec_id * 2 + 2, 0, vec_id * 2, 2 * ((vec_id + 1 + (vec_id * 13) % (n - 1)) % n),
               CASE WHEN v[1] >= 0 THEN 'custom' ELSE 'pretrained' END
        FROM vec CROSS JOIN size_of""",
    "pair_rows": f"""
        SELECT pair_id, label_same, key1, key2, pipeline, status,
               CASE WHEN status = 'ok' THEN score END AS score,
               CASE WHEN status = 'missing_image' THEN
                    concat_ws('; ', CASE WHEN s1 IS NULL THEN key1::VARCHAR END, CASE WHEN s2 IS NULL THEN key2::VARCHAR END)
                    WHEN status <> 'ok' THEN status ELSE '' END AS error
        FROM (SELECT p.*, a.status AS s1, b.status AS s2, round({cos('a.v', 'b.v')}, 6) AS score,
                     CASE WHEN a.status IS NULL OR b.status IS NULL THEN 'missing_image'
                          WHEN a.status <> 'ok' THEN a.status WHEN b.status <> 'ok' THEN b.status ELSE 'ok' END AS status
              FROM pairs p LEFT JOIN views a ON a.key = p.key1 LEFT JOIN views b ON b.key = p.key2)""",
    "scored": "SELECT pair_id, pipeline, score, label_same AS label FROM pair_rows WHERE status = 'ok'",
    "grid": """
        SELECT DISTINCT score AS threshold FROM scored
        UNION ALL SELECT nextafter(min(score), '-infinity'::DOUBLE) FROM scored
        UNION ALL SELECT nextafter(max(score), 'infinity'::DOUBLE) FROM scored""",
    "counts": """
        SELECT threshold,
               count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp,
               count(*) FILTER (WHERE score >= threshold AND label = 0) AS fp,
               count(*) FILTER (WHERE score < threshold AND label = 0) AS tn,
               count(*) FILTER (WHERE score < threshold AND label = 1) AS fn
        FROM grid CROSS JOIN scored GROUP BY threshold""",
    "curve": """
        SELECT *, fp / (fp + tn) AS far, fn / (tp + fn) AS frr, tp / (tp + fn) AS tar,
               (tp + tn) / (tp + fp + tn + fn) AS accuracy
        FROM counts""",
    "subjects": """
        SELECT c_custkey AS id, c_mktsegment || '_' || c_nationkey::VARCHAR AS label,
               CASE WHEN c_acctbal < 500 THEN 'deleted' ELSE 'active' END AS status,
               TIMESTAMP '2024-01-01 00:00:00' + to_minutes(floor(c_acctbal)::BIGINT) AS created_at
        FROM customer""",
    "templates": """
        SELECT o_orderkey AS id, o_custkey AS person_id,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'custom' ELSE 'pretrained' END AS pipeline,
               o_orderpriority AS model, 512 AS dim, o_orderdate AS created_at, o_orderstatus <> 'F' AS is_active
        FROM orders""",
    "live": """
        SELECT t.* FROM templates t JOIN subjects s ON s.id = t.person_id
        WHERE t.is_active AND s.status = 'active'""",
    "audit": """
        SELECT event_id, event_type, CASE WHEN value >= 100 THEN 'admin' ELSE 'operator' END AS actor_role,
               '/v1/' || event_type AS route, 200 AS status_code, props AS details, ts AS created_at,
               value AS latency_ms, user_id
        FROM events""",
    "frames": """
        SELECT user_id AS session, ts, event_id AS frame_id,
               CASE WHEN value >= 10 THEN 'custom' ELSE 'pretrained' END AS pipeline,
               CASE WHEN event_type = 'error' THEN 'unknown' ELSE 'match' END AS decision,
               event_type AS label, least(value / 40, 1.0) AS score, 0.205047::DOUBLE AS threshold
        FROM events""",
    "detections": """
        SELECT event_id // 4 AS image_id, event_id % 4 AS face_index,
               CASE WHEN event_type = 'error' THEN NULL ELSE [x1, y1, x1 + side, y1 + side] END AS bbox,
               least(round(value / 100, 4), 1.0) AS det_score,
               CASE WHEN event_type <> 'signup' THEN 120 END AS width,
               CASE WHEN event_type <> 'signup' THEN 90 END AS height,
               round(value * 2, 2) AS blur
        FROM (SELECT *, value % 40 AS x1, k % 30 AS y1, round(20 + k, 2) AS side
              FROM (SELECT *, (props ->> '$.k')::DOUBLE AS k FROM events))""",
}


def with_tables(select: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """``select`` with the tables it names, and the tables those name, put before it."""
    known = {**TABLES, **(extra or {})}
    needed: dict[str, str] = {}

    def visit(text: str, own: str = "") -> None:
        for name in re.findall(r"\b[a-z_0-9]+\b", text):
            if name in known and name != own and name not in needed and re.search(rf"(FROM|JOIN)\s+{name}\b", text):
                visit(known[name], name)
                needed[name] = known[name]

    visit(select)
    if not needed:
        return select
    word = "WITH RECURSIVE" if recursive else "WITH"
    return f"{word} " + ",\n".join(f"{name} AS ({body})" for name, body in needed.items()) + "\n" + select
