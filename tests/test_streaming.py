import os
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probewise.streaming import events as ev
from probewise.streaming import keyed, smoothing, throttle

START = datetime(2024, 1, 1)


def run(stream, tmp_path):
    query = (
        stream.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def as_files(df, parts, tmp_path):
    for part in parts:
        df.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    reader = df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
    return reader.parquet(str(tmp_path / "in"))


REQUEST = "event_id long, category string, identity string, ts timestamp"


def requests(seed, n=400):
    rnd = random.Random(seed)
    rows, t = [], 0.0
    for i in range(n):
        t += rnd.choice([0.0, 0.5, 3.0, 3.0, 20.0, 61.0, 200.0])
        # one key has most of the events
        key = rnd.choice([("search", "hot")] * 4 + [("enroll", "hot"), ("search", "b"), ("free", "b")])
        rows.append((i, *key, START + timedelta(seconds=t)))
    return rows


LIMITS = {"search": 3, "enroll": 1, "free": 0}


def verdicts(df):
    return {r["event_id"]: (r["allowed"], r["remaining"], r["retry_after"]) for r in df.collect()}


def check_promise(rows, found):
    """Every verdict against the allowed events of the window before it."""
    by_key = defaultdict(list)
    for i, category, identity, ts in sorted(rows, key=lambda r: (r[3], r[0])):
        by_key[category, identity].append((i, (ts - START).total_seconds()))
    assert set(found) == {r[0] for r in rows}
    for (category, _), events in by_key.items():
        limit = LIMITS[category]
        for place, (i, now) in enumerate(events):
            allowed, remaining, wait = found[i]
            recent = [t for j, t in events[:place] if found[j][0] and t > now - 60]
            if limit == 0:
                assert (allowed, remaining, wait) == (True, 0, 0)
            elif allowed:
                assert len(recent) < limit and (remaining, wait) == (limit - len(recent) - 1, 0)
            else:
                # refused only where the window is full; the wait ends when its first event leaves
                assert len(recent) == limit and remaining == 0
                assert wait >= 1 and recent[0] + 60 <= now + wait < max(recent[0] + 61, now + 2)


@pytest.mark.parametrize("seed, range_rows", [(1, 10_000), (2, 20)])
def test_throttle_keeps_its_promise(spark, seed, range_rows):
    rows = requests(seed)
    found = throttle.throttle(spark.createDataFrame(rows, REQUEST).repartition(5), LIMITS, 60, range_rows)
    check_promise(rows, verdicts(found))


def test_throttle_of_null_keys(spark):
    rows = [(1, None, "a", START), (2, "enroll", None, START), (3, "enroll", None, START + timedelta(seconds=5))]
    found = verdicts(throttle.throttle(spark.createDataFrame(rows, REQUEST), LIMITS, 60))
    assert found == {1: (True, 0, 0), 2: (True, 0, 0), 3: (False, 0, 55)}


def test_a_place_is_free_exactly_after_the_window(spark):
    rows = [(1, "enroll", "a", START), (2, "enroll", "a", START + timedelta(seconds=59.9)), (3, "enroll", "a", START + timedelta(seconds=60))]
    found = verdicts(throttle.throttle(spark.createDataFrame(rows, REQUEST), LIMITS, 60))
    assert found == {1: (True, 0, 0), 2: (False, 0, 1), 3: (True, 0, 0)}


def test_busy_time_is_cut_where_it_pauses(spark):
    df = spark.createDataFrame(requests(3), REQUEST).select("event_id", "category", "identity", throttle.event_micros().alias("at"))
    segments = throttle.with_idle_segments(df, 60 * throttle.MICROS, 50)
    assert segments.where("identity = 'hot' AND category = 'search'").select("segment").distinct().count() > 5


def test_throttle_stream_equals_batch(spark, tmp_path):
    rows = requests(4, 120)
    last = max(r[3] for r in rows)
    rows.append((999, "none", "marker", last + timedelta(seconds=1)))
    df = spark.createDataFrame(rows, REQUEST)
    cuts = [F.lit(START), *[F.lit(START + (last - START) * q) for q in (0.3, 0.6)], F.lit(last + timedelta(days=1))]
    parts = [(F.col("ts") >= a) & (F.col("ts") < b) & (F.col("event_id") < 999) for a, b in zip(cuts, cuts[1:])]
    stream = as_files(df, [*parts, F.col("event_id") == 999], tmp_path)
    found = verdicts(run(throttle.throttle_stream(stream, {**LIMITS, "none": 0}, 60), tmp_path))
    found.pop(999, None)
    check_promise(rows[:-1], found)


FRAME = "session string, ts timestamp, frame_id long, pipeline string, decision string, label string, score double, threshold double"


def frames(seed, n=300):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        session = rnd.choice(["hot", "hot", "hot", "b", "c"])
        label, decision = rnd.choice(["x", "x", "y", "z", "", None]), rnd.choice(["match", "Match", "match", "unknown"])
        rows.append((session, START + timedelta(seconds=i // 2), i, "custom" if session != "c" else "pretrained", decision, label, round(rnd.uniform(0.2, 0.4), 2), 0.25))
    return rows


def shown(df):
    return {r["frame_id"]: r["stable_label"] for r in df.collect()}


def script(pipeline, steps):
    """Frames of one session, a second apart: label and score of each step, None for no match."""
    return [
        ("s", START + timedelta(seconds=i), i, pipeline, "match" if step else "unknown", step[0] if step else None, step[1] if step else 0.9, 0.25)
        for i, step in enumerate(steps)
    ]


X, Y = ("x", 0.36), ("y", 0.36)
SCRIPTS = [
    # two of the last five agree; then the label is held for three frames without it and given up at the fourth
    ("custom", [X, X, None, None, None, None, None, None, None], [None, "x", "x", "x", "x", "x", "x", "x", None]),
    # two weak ones don't agree in the custom space, three do; one below 0.30 doesn't count
    ("custom", [("x", 0.31), ("x", 0.31), ("x", 0.31), ("x", 0.29)], [None, None, "x", "x"]),
    ("pretrained", [("x", 0.26), ("x", 0.26), None], [None, "x", "x"]),
    # a new label takes over once it agrees with itself and scores better
    ("custom", [X, X, ("y", 0.39), ("y", 0.39)], [None, "x", "x", "y"]),
    ("pretrained", [None, ("x", 0.2), ("x", 0.24), Y], [None, None, None, None]),
]


@pytest.mark.parametrize("pipeline, steps, wanted", SCRIPTS)
def test_smoothing_by_hand(spark, pipeline, steps, wanted):
    found = shown(smoothing.stabilize_labels(spark.createDataFrame(script(pipeline, steps), FRAME)))
    assert [found[i] for i in range(len(steps))] == wanted


def test_smoothing_does_not_depend_on_pieces(spark):
    df = spark.createDataFrame(frames(1), FRAME).repartition(3).cache()
    whole = shown(smoothing.stabilize_labels(df, 1_000, 1_000))
    assert all(shown(smoothing.stabilize_labels(df, *cut)) == whole for cut in ((20, 25), (11, 60), (9, 17)))
    # a shown label was matched in the session before, or in that frame
    rows = {r["frame_id"]: r for r in df.collect()}
    for i, label in whole.items():
        seen = {r["label"] for j, r in rows.items() if j <= i and r["session"] == rows[i]["session"] and r["decision"].lower() == "match"}
        assert label is None or label in seen


def test_smoothing_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(frames(5, 120), FRAME)
    parts = [F.col("frame_id").between(a, b) for a, b in ((0, 39), (40, 79), (80, 200))]
    assert shown(run(smoothing.stabilize_stream(as_files(df, parts, tmp_path)), tmp_path)) == shown(smoothing.stabilize_labels(df))


AUDIT = "event_type string, actor_role string, route string, status_code int, details string, created_at timestamp"


def test_audit_is_appended_and_pruned(spark, tmp_path):
    now = datetime(2024, 6, 1)
    rows = [("a", "admin", "/v1/x", 200, "{}", now - timedelta(days=d)) for d in (0, 29, 30, 31, 90)]
    df = spark.createDataFrame(rows, AUDIT)
    stream = as_files(df, [F.lit(True)], tmp_path)
    ev.append_audit(stream, str(tmp_path / "audit"), str(tmp_path / "ck")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "audit"))
    assert stored.count() == 5 and stored.columns == list(ev.AUDIT_COLUMNS)
    kept, removed = ev.prune_audit(stored, now)
    assert kept.count() == 3 and removed.first()["removed"] == 2


@pytest.mark.parametrize(
    "method, path, category",
    [
        ("post", "/v1/search/", "search"), ("POST", "/v1/enroll", "enroll"), ("POST", "/v1/index/rebuild", "admin"), ("DELETE", "/v1/persons/9", "admin"),
        ("DELETE", "/v1/persons/", None), ("GET", "/v1/search", None), ("POST", "/v2/search", None), ("POST", "/", None),
    ],
)
def test_routes(spark, method, path, category):
    assert spark.range(1).select(ev.route_category(F.lit(method), F.lit(path))).first()[0] == category


def test_callers(spark):
    known = spark.range(1).select(F.sha2(F.lit("secret"), 256).alias("key_hash"))
    calls = spark.createDataFrame([(1, "secret", "h"), (2, "wrong", "h"), (3, None, ""), (4, "", None)], "id long, api_key string, host string")
    out = ev.caller_identity(calls, known)
    assert "api_key" not in out.columns
    rows = {r["id"]: r["caller"] for r in out.collect()}
    assert rows[1] == "api:" + known.first()[0] and (rows[2], rows[3], rows[4]) == ("ip:h", "ip:unknown", "ip:unknown")


def test_activity_in_batch_and_stream(spark, tmp_path):
    rows = [("a", "admin", "/", 200, "{}", START + timedelta(minutes=m)) for m in (1, 59, 61, 200)]
    df = spark.createDataFrame(rows, AUDIT)
    batch = {(r["window_start"], r["events"]) for r in ev.activity_counts(df).collect()}
    assert batch == {(START, 2), (START + timedelta(hours=1), 1), (START + timedelta(hours=3), 1)}
    stream = ev.activity_counts(as_files(df, [F.lit(True)], tmp_path))
    closed = {(r["window_start"], r["events"]) for r in run(stream, tmp_path).collect()}
    assert closed == {(START, 2), (START + timedelta(hours=1), 1)}


# keyed state


def state_rows(spark, tmp_path, name):
    return spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "state"))


def out_of_order(spark, rows, schema, tmp_path, order, ts):
    """Files in which the rows come shuffled within the delay, and a marker far behind them."""
    ordered = sorted(rows, key=order)
    parts = [ordered[i : i + 60] for i in range(0, len(ordered), 60)]
    for number, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_smoothing_in_any_order_and_idle(spark, tmp_path):
    rnd, rows = random.Random(3), frames(7, 240)
    # pauses of a minute, in which sessions fall silent
    rows = [(r[0], r[1] + timedelta(seconds=60 * (i // 50)), *r[2:]) for i, r in enumerate(rows)]
    batch = shown(smoothing.stabilize_labels(spark.createDataFrame(rows, FRAME), 15, 40, idle_seconds=30))
    assert batch == shown(smoothing.stabilize_labels(spark.createDataFrame(rows, FRAME), idle_seconds=30))
    assert batch != shown(smoothing.stabilize_labels(spark.createDataFrame(rows, FRAME)))
    marker = ("marker", rows[-1][1] + timedelta(hours=1), 10_000, "custom", "unknown", None, 0.0, 0.25)
    late = {r[2]: r[1] + timedelta(seconds=rnd.uniform(0, 20)) for r in rows} | {10_000: marker[1]}
    stream = out_of_order(spark, [*rows, marker], FRAME, tmp_path, lambda r: late[r[2]], 1)
    found = shown(run(smoothing.stabilize_stream(stream, "40 seconds", 30, 7), tmp_path))
    found.pop(10_000, None)
    assert found == batch
    # silent sessions have left no state, the marker has
    assert {r["key"]["session"] for r in state_rows(spark, tmp_path, "kept").collect()} <= {"marker"}
    assert {r["key"]["session"] for r in state_rows(spark, tmp_path, "rows").collect()} <= {"marker"}


def test_throttle_in_any_order(spark, tmp_path):
    rnd, rows = random.Random(5), requests(6, 200)
    last = max(r[3] for r in rows)
    late = {r[0]: r[3] + timedelta(seconds=rnd.uniform(0, 25)) for r in rows}
    rows.append((999, "none", "marker", last + timedelta(hours=1)))
    late[999] = rows[-1][3]
    stream = out_of_order(spark, rows, REQUEST, tmp_path, lambda r: late[r[0]], 3)
    found = verdicts(run(throttle.throttle_stream(stream, {**LIMITS, "none": 0}, 60, "40 seconds", 11), tmp_path))
    found.pop(999, None)
    check_promise(rows[:-1], found)
    assert {r["key"]["identity"] for r in state_rows(spark, tmp_path, "kept").collect()} <= {"marker"}


def test_a_hot_key_is_worked_on_slot_by_slot(spark, tmp_path):
    class Largest:
        """A rule that reports the rows it is handed at a time."""

        state = "seen long"

        def begin(self):
            return (0,)

        def apply(self, key, state, rows):
            return (state[0] + len(rows),), pd.DataFrame({"k": [key[0]], "n": [len(rows)], "seen": [state[0] + len(rows)]})

        def until(self, state):
            return None

    rows = [(1, START + timedelta(seconds=(i * 7919) % 6000), i) for i in range(6000)]
    source = spark.createDataFrame(rows, "k long, ts timestamp, id long")
    stream = as_files(source, [F.lit(True)], tmp_path).withColumn("at", F.unix_micros("ts"))
    found = run(keyed.apply_in_order(stream, ["k"], "id", Largest(), T.StructType.fromDDL("k long, n long, seen long"), None, 60), tmp_path)
    handed = sorted((r["seen"], r["n"]) for r in found.collect())
    assert handed == [(60 * (i + 1), 60) for i in range(100)]


class Stored(dict):
    """A state variable, map or value, that counts its calls."""

    calls = 0

    def __getattribute__(self, name):
        if name in ("keys", "getValue", "updateValue", "removeKey", "get", "update", "clear"):
            Stored.calls += 1
        return super().__getattribute__(name)

    def keys(self):
        return list(self)

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def get(self):
        return self["value"] if "value" in self else None

    def update(self, value):
        self["value"] = value


class Handle:
    def __init__(self):
        self.timers, self.states = set(), {}

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Stored())

    def getValueState(self, name, *_):
        return self.states.setdefault(name, Stored())

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


class Handed:
    """Hands on what it gets, and counts it."""

    state = "seen long"

    def begin(self):
        return (0,)

    def apply(self, key, state, rows):
        return (state[0] + len(rows),), rows

    def until(self, state):
        return None


def keyed_run(waits, steps):
    """What is handed on of one key: the batches of a trigger, and the watermark after it, in milliseconds."""
    fields = T.StructType.fromDDL("at long, id long, c string")
    processor, handle, out = keyed.InTimeOrder(fields, "id", Handed(), 10, waits), Handle(), []
    processor.init(handle)
    Stored.calls = 0
    for batches, passed in steps:
        out += list(processor.handleInputRows(("k",), iter(batches), None))
        for at in sorted(t for t in handle.timers if t <= passed):
            handle.timers.remove(at)
            out += list(processor.handleExpiredTimer(("k",), Watermark(passed), None))
    rows = [tuple(r) for part in out for r in part[["at", "id"]].itertuples(index=False, name=None)]
    return rows, handle, Stored.calls


def far_apart(n, seed, low=0):
    """Rows of as many slots of ten seconds, in any order."""
    ids = list(range(low, low + n))
    random.Random(seed).shuffle(ids)
    return pd.DataFrame({"at": [i * 10_000_000 for i in ids], "id": ids, "c": [None if i % 3 else "x" for i in ids]})


def test_rows_of_many_slots_take_few_calls_to_the_state(spark):
    rows, _, calls = keyed_run(False, [([far_apart(200, 1)], 0), ([far_apart(200, 2, 200)], 0)])
    assert [r[1] for r in rows] == list(range(400)) and calls <= 4
    rows, handle, calls = keyed_run(True, [([far_apart(200, 1)], 0), ([far_apart(200, 2, 200)], 10_000_000)])
    assert [r[1] for r in rows] == list(range(400)) and calls <= 20
    assert not handle.states["rows"]


@pytest.mark.parametrize("waits", [False, True])
def test_rows_without_a_time_are_left_out(spark, waits):
    batch = pd.DataFrame({"at": [None, 2e7, 1e7], "id": [1, 2, 3], "c": ["x", None, "y"]})
    rows, _, _ = keyed_run(waits, [([batch, batch[:1]], 0), ([batch[:1]], 10**6)])
    assert rows == [(10**7, 3), (2 * 10**7, 2)]


@pytest.mark.parametrize("part_rows", [1, 40, 130, 4096])
def test_waiting_rows_come_in_order_however_they_are_stored(spark, monkeypatch, part_rows):
    monkeypatch.setattr(keyed, "PART_ROWS", part_rows)
    rnd, rows = random.Random(part_rows), far_apart(300, 4)
    rows["at"] = rows["at"] // 7
    # a row comes up to 60 seconds late, and the watermark waits as long
    rows = rows.iloc[sorted(range(300), key=lambda i: rows["at"][i] + rnd.uniform(0, 60e6))].reset_index(drop=True)
    steps, latest = [], 0
    for low in range(0, 300, 50):
        batches = [rows[low : low + 20], rows[low + 20 : low + 50]]
        latest = max(latest, int(rows["at"][low : low + 50].max()))
        steps.append((batches, latest // 1000 - 60_000))
    found, handle, _ = keyed_run(True, [*steps, ([], 10**9)])
    assert found == sorted(zip(rows["at"], rows["id"])) and not handle.states["rows"]
    assert handle.states["kept"]["value"][:3] == (0, 0, None) and handle.states["kept"]["value"][3] == 300


def test_the_log_is_pruned_by_day(spark, tmp_path):
    now = datetime(2024, 6, 1, 12)
    rows = [("a", "admin", "/v1/x", 200, str(i), now - timedelta(hours=i)) for i in range(900)]
    df = spark.createDataFrame(rows, AUDIT)
    path = str(tmp_path / "log")
    stream = as_files(df, [F.col("details").cast("int") % 3 == part for part in range(3)], tmp_path)
    ev.append_audit_by_day(stream, path, str(tmp_path / "ck")).awaitTermination()
    assert ev.read_audit(spark, path).count() == 900

    def stored():
        return {f"{top}/{n}": os.stat(f"{top}/{n}").st_mtime_ns for top, _, names in os.walk(path) for n in names if n.endswith(".parquet")}

    before = stored()
    found = ev.prune_audit_by_day(spark, path, now, 30)
    cutoff = now - timedelta(days=30)
    kept, removed = ev.prune_audit(df, now, 30)
    assert found.removed == removed.first()["removed"] == sum(r[5] < cutoff for r in rows)
    assert sorted(r["details"] for r in ev.read_audit(spark, path).collect()) == sorted(r["details"] for r in kept.collect())
    # only partitions of the boundary day are written, and dropped ones are gone
    after = stored()
    written = {f.split("day=")[1][:10] for f, t in after.items() if before.get(f) != t}
    assert written == {str(cutoff.date())} and all(f"day={cutoff.date()}" in f for f in found.rewritten)
    assert min(f.split("day=")[1][:10] for f in after) == str(cutoff.date())
    assert ev.prune_audit_by_day(spark, path, now, 30) == ev.Pruned(0, [], []) and stored() == after
