"""Registered queries over audit events, requests and live frames."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probewise.plans import tables
from probewise.plans.registry import query
from probewise.plans.table_queries import scratch
from probewise.streaming import events as ev
from probewise.streaming.smoothing import stabilize_labels, stabilize_stream
from probewise.streaming.throttle import throttle, throttle_stream

STAMP = "yyyy-MM-dd HH:mm:ss"
# events are sparse, so the throttle looks at long windows
WINDOW_SECONDS = 24 * 3600
LIMITS = {"search": 60, "click": 1, "view": 2, "purchase": 3, "signup": 0, "error": 2}


def events_stream(spark, sf_dir) -> DataFrame:
    """The given events as a file stream."""
    schema = tables.read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")


@query(
    "e1_append_audit",
    """SELECT event_type, actor_role, route, status_code, details, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM audit""",
)
def e1(spark, sf_dir):
    path = scratch(spark)
    ev.append_audit(tables.as_audit(events_stream(spark, sf_dir)), f"{path}/audit", f"{path}/state").awaitTermination()
    stored = spark.read.parquet(f"{path}/audit")
    return stored.withColumn("created_at", F.date_format("created_at", STAMP))


@query(
    "e2_prune_audit",
    """SELECT event_id, actor_role, (SELECT count(*) FROM audit WHERE created_at < TIMESTAMP '2024-01-11 12:00:00') AS removed
       FROM audit WHERE created_at >= TIMESTAMP '2024-01-11 12:00:00'""",
)
def e2(spark, sf_dir):
    kept, removed = ev.prune_audit(tables.audit(spark, sf_dir), F.lit("2024-02-10 12:00:00").cast("timestamp_ntz"), 30)
    return kept.select("event_id", "actor_role", removed.scalar().alias("removed"))


# the log stored by day, pruned twice: whole days go, of the boundary day the kept rows are written again
@query(
    "e2_prune_by_day",
    """SELECT event_id, actor_role, removed, (SELECT count(DISTINCT created_at::DATE) FROM audit WHERE created_at::DATE < DATE '2024-01-11') AS days_dropped,
              0::BIGINT AS removed_again
       FROM (SELECT event_id, actor_role, created_at, count(*) FILTER (WHERE created_at < TIMESTAMP '2024-01-11 12:00:00') OVER () AS removed FROM audit)
       WHERE created_at >= TIMESTAMP '2024-01-11 12:00:00'""",
)
def e2_by_day(spark, sf_dir):
    path = scratch(spark)
    rows = tables.as_audit(events_stream(spark, sf_dir)).withColumn("created_at", F.col("created_at").cast("timestamp"))
    # the event's id stands for the details
    numbered = rows.withColumn("details", F.col("event_id").cast("string"))
    ev.append_audit_by_day(numbered, f"{path}/log", f"{path}/state").awaitTermination()
    now = datetime(2024, 2, 10, 12)
    first, second = (ev.prune_audit_by_day(spark, f"{path}/log", now, 30) for _ in range(2))
    days = {folder.split("/")[0] for folder in first.dropped if folder < "day=2024-01-11"}
    return ev.read_audit(spark, f"{path}/log").select(
        F.col("details").cast("long").alias("event_id"),
        "actor_role",
        F.lit(first.removed).cast("long").alias("removed"),
        F.lit(len(days)).cast("long").alias("days_dropped"),
        F.lit(second.removed).cast("long").alias("removed_again"),
    )


THROTTLED = {
    "request_ranks": """
        SELECT event_id, event_type AS category, user_id::VARCHAR AS identity, epoch_us(ts) AS us,
               CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 2 ELSE 0 END AS lim,
               row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS place
        FROM events""",
    "judged": """
        SELECT r.*, lim <= 0 OR true AS allowed, CASE WHEN lim <= 0 THEN []::BIGINT[] ELSE [us] END AS log,
               CASE WHEN lim <= 0 THEN 0 ELSE lim - 1 END AS remaining, 0::BIGINT AS retry_after
        FROM request_ranks r WHERE place = 1
        UNION ALL
        SELECT event_id, category, identity, us, lim, place, lim <= 0 OR len(log) < lim,
               CASE WHEN lim > 0 AND len(log) < lim THEN list_append(log, us) ELSE log END,
               CASE WHEN lim > 0 AND len(log) < lim THEN lim - len(log) - 1 ELSE 0 END,
               CASE WHEN lim > 0 AND len(log) >= lim
                    THEN greatest(1, ceil((log[1] + 86400000000 - us) / 1000000))::BIGINT ELSE 0 END
        FROM (SELECT n.*, list_filter(j.log, lambda t: t > n.us - 86400000000) AS log
              FROM judged j JOIN request_ranks n
                ON n.category = j.category AND n.identity = j.identity AND n.place = j.place + 1)""",
}
JUDGED = "SELECT event_id, category, identity, allowed, remaining::BIGINT AS remaining, retry_after FROM judged"


@query("e3_throttle", JUDGED, extra=THROTTLED, recursive=True)
def e3(spark, sf_dir):
    return throttle(tables.requests(spark, sf_dir), LIMITS, WINDOW_SECONDS)


def run_to_table(stream: DataFrame, path: str) -> DataFrame:
    (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


# the stream holds back what its watermark has not passed; one event after the
# last real one lets it pass
@query("e3_throttle_stream", JUDGED, extra=THROTTLED, recursive=True)
def e3_stream(spark, sf_dir):
    path = scratch(spark)
    last = tables.requests(spark, sf_dir).agg(
        F.lit(-1).cast("long").alias("event_id"),
        F.lit("none").alias("category"),
        F.lit("end").alias("identity"),
        (F.max("ts") + F.expr("interval 1 second")).alias("ts"),
    )
    last.write.parquet(f"{path}/last")
    end = spark.readStream.schema(last.schema).parquet(f"{path}/last")
    requests = tables.as_requests(events_stream(spark, sf_dir)).unionByName(end)
    return run_to_table(throttle_stream(requests, LIMITS, WINDOW_SECONDS), path).where("event_id >= 0")


@query(
    "e4_route_category",
    """SELECT event_id, CASE WHEN event_type = 'purchase' AND value >= 10 THEN 'search' WHEN event_type = 'signup' AND value >= 10 THEN 'enroll'
                              WHEN event_type = 'error' THEN 'admin' WHEN event_type = 'view' AND value >= 50 THEN 'admin' END AS category
       FROM events""",
)
def e4(spark, sf_dir):
    kind, big = F.col("event_type"), F.col("value") >= 10
    method = F.when(kind == "error", "delete").when(kind.isin("purchase", "signup") & ~big, "GET").otherwise("post")
    path = (
        F.when(kind == "purchase", "/v1/search//")
        .when(kind == "signup", "/v1/enroll")
        .when(kind == "error", F.concat(F.lit("/v1/persons/"), "user_id"))
        .when((kind == "view") & (F.col("value") >= 50), "/v1/index/rebuild/")
        .otherwise("/v1/search/extra")
    )
    rows = tables.read(spark, sf_dir, "events")
    return rows.select("event_id", ev.route_category(method, path).alias("category"))


@query(
    "e5_caller_identity",
    """SELECT event_id, CASE WHEN k.hash IS NOT NULL THEN 'api:' || k.hash WHEN value < 2 THEN 'ip:unknown' ELSE 'ip:h' || user_id END AS caller
       FROM events LEFT JOIN (SELECT sha256(c_name) AS hash, c_custkey FROM customer WHERE c_acctbal > 3000) k
         ON k.c_custkey = events.user_id AND event_type <> 'view'""",
)
def e5(spark, sf_dir):
    customers = tables.read(spark, sf_dir, "customer")
    keys = customers.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("api_key"))
    known = customers.where("c_acctbal > 3000").select(F.sha2("c_name", 256).alias("key_hash"))
    calls = tables.read(spark, sf_dir, "events").join(keys, "user_id", "left").select(
        "event_id",
        F.when(F.col("event_type") != "view", F.col("api_key")).alias("api_key"),
        F.when(F.col("value") >= 2, F.concat(F.lit("h"), "user_id")).otherwise("").alias("host"),
    )
    return ev.caller_identity(calls, known).select("event_id", "caller")


SMOOTHED = {
    "offers": """
        SELECT session, frame_id, pipeline, row_number() OVER (PARTITION BY session ORDER BY ts, frame_id) AS place,
               CASE WHEN decision = 'match' AND score >= greatest(threshold, CASE WHEN pipeline = 'custom' THEN 0.3 ELSE threshold END)
                    THEN {'l': label, 's': score} END AS offer
        FROM frames""",
    "smoothed": """
        SELECT session, frame_id, place, [offer] AS history, NULL::VARCHAR AS held, 0 AS misses FROM offers WHERE place = 1
        UNION ALL
        SELECT session, frame_id, place, history,
               CASE WHEN agreed IS NOT NULL THEN agreed WHEN held IS NULL OR missed >= 4 THEN NULL ELSE held END,
               CASE WHEN agreed IS NOT NULL OR held IS NULL OR missed >= 4 THEN 0 ELSE missed END
        FROM (SELECT o.session, o.frame_id, o.place, h.history, h.held,
                     CASE WHEN o.offer.l = h.held THEN 0 ELSE h.misses + 1 END AS missed,
                     list_min(list_filter(list_transform(list_distinct(list_transform(list_filter(h.history, lambda x: x IS NOT NULL), lambda x: x.l)),
                         lambda l: {'m': -list_max(list_transform(list_filter(h.history, lambda x: x.l = l), lambda x: x.s)), 'l': l,
                                    'n': len(list_filter(h.history, lambda x: x.l = l))}),
                         lambda d: CASE WHEN o.pipeline = 'custom' THEN (d.n >= 2 AND -d.m >= 0.34) OR (d.n >= 3 AND -d.m >= 0.26)
                                        ELSE d.n >= 2 END)).l AS agreed
              FROM (SELECT s.session, s.place, s.held, s.misses, list_slice(list_append(s.history, n.offer), -5, -1) AS history
                    FROM smoothed s JOIN offers n ON n.session = s.session AND n.place = s.place + 1) h
              JOIN offers o ON o.session = h.session AND o.place = h.place + 1)""",
}
STABLE = "SELECT session, frame_id, held AS stable_label FROM smoothed"


@query("e6_stabilize_labels", STABLE, extra=SMOOTHED, recursive=True)
def e6(spark, sf_dir):
    return stabilize_labels(tables.frames(spark, sf_dir))


@query("e6_stabilize_stream", STABLE, extra=SMOOTHED, recursive=True)
def e6_stream(spark, sf_dir):
    return run_to_table(stabilize_stream(tables.as_frames(events_stream(spark, sf_dir))), scratch(spark))


# a session that pauses for a day starts anew; frames wait for the watermark, and silent sessions leave the state
IDLE_SECONDS = 24 * 3600
PAUSED = {
    "visits": f"""
        SELECT * EXCLUDE (paused), sum(paused::INT) OVER (PARTITION BY session ORDER BY ts, frame_id) AS visit
        FROM (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY session ORDER BY ts, frame_id)) > {IDLE_SECONDS}000000, false) AS paused
              FROM frames)""",
    **{
        name: body.replace("PARTITION BY session", "PARTITION BY session, visit")
        .replace("FROM frames", "FROM visits")
        .replace("SELECT session, frame_id, pipeline", "SELECT session, visit, frame_id, pipeline")
        .replace("SELECT session, frame_id, place", "SELECT session, visit, frame_id, place")
        .replace("SELECT o.session, o.frame_id", "SELECT o.session, o.visit, o.frame_id")
        .replace("SELECT s.session, s.place", "SELECT s.session, s.visit, s.place")
        .replace("ON n.session = s.session", "ON n.session = s.session AND n.visit = s.visit")
        .replace("ON o.session = h.session", "ON o.session = h.session AND o.visit = h.visit")
        for name, body in SMOOTHED.items()
    },
}


@query("e6_stabilize_idle", STABLE, extra=PAUSED, recursive=True)
def e6_idle(spark, sf_dir):
    return stabilize_labels(tables.frames(spark, sf_dir), idle_seconds=IDLE_SECONDS)


@query("e6_stabilize_idle_stream", STABLE, extra=PAUSED, recursive=True)
def e6_idle_stream(spark, sf_dir):
    path = scratch(spark)
    events = tables.read(spark, sf_dir, "events")
    # a frame far behind the others lets the watermark pass them
    last = events.agg((F.max("ts") + F.expr("interval 2 days")).alias("ts"))
    schema = tables.as_frames(events).schema
    marker = last.select(F.lit(-1).cast("long").alias("session"), "ts", F.lit(-1).cast("long").alias("frame_id"))
    marker.write.parquet(f"{path}/last")
    end = spark.readStream.schema(marker.schema).parquet(f"{path}/last")
    others = {f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in marker.columns}
    frames = tables.as_frames(events_stream(spark, sf_dir)).unionByName(end.withColumns(others))
    stream = stabilize_stream(frames, "1 hour", IDLE_SECONDS, slot_seconds=24 * 3600)
    return run_to_table(stream, path).where("frame_id >= 0")


@query(
    "e7_activity_counts",
    """SELECT strftime(time_bucket(INTERVAL 6 HOUR, created_at), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, actor_role, count(*) AS events
       FROM audit GROUP BY ALL""",
)
def e7(spark, sf_dir):
    counts = ev.activity_counts(tables.audit(spark, sf_dir), "6 hours")
    return counts.select(F.date_format("window_start", STAMP).alias("window_start"), "event_type", "actor_role", "events")


# the events come in three parts by time, written one after the other; rows wait for a part's length
STREAMED = {
    "span": "SELECT (max(epoch_us(created_at)) - min(epoch_us(created_at))) // 3000000 + 1 AS part, max(created_at) AS last FROM audit",
    "windows": """
        SELECT time_bucket(INTERVAL 6 HOUR, created_at) AS begins, event_type, actor_role, count(*) AS events
        FROM audit GROUP BY ALL""",
}


@query(
    "e7_activity_counts_stream",
    """SELECT strftime(begins, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, actor_role, events
       FROM windows CROSS JOIN span WHERE begins + INTERVAL 6 HOUR <= last - to_seconds(part)""",
    extra=STREAMED,
)
def e7_stream(spark, sf_dir):
    """Counts of the windows that are closed when the last event is in, over many batches."""
    path = scratch(spark)
    audit = tables.audit(spark, sf_dir).withColumn("created_at", F.col("created_at").cast("timestamp"))
    at = F.unix_micros("created_at")
    first, last = audit.agg(F.min(at), F.max(at)).first()
    seconds = ((last or 0) - (first or 0)) // 3_000_000 + 1
    for part in range(3):
        own = F.floor((at - (first or 0)) / (seconds * 1_000_000)) == part
        audit.where(own).write.mode("append").parquet(f"{path}/events")
    stream = spark.readStream.schema(audit.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/events")
    counts = ev.activity_counts(stream, "6 hours", f"{seconds} seconds")
    stored = run_to_table(counts, path)
    return stored.select(F.date_format("window_start", STAMP).alias("window_start"), "event_type", "actor_role", "events")
