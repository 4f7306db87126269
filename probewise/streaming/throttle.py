"""Sliding-log throttle over request events.

Events are ``(event_id, category, identity, ts)``. An event is allowed while
fewer than ``limit`` allowed events lie in the window before it; refused
events leave no trace.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probewise.operators.ordered import RANGE_ROWS, join_on, running_sums
from probewise.streaming.keyed import SLOT_SECONDS, apply_in_order

MICROS = 1_000_000
# fixed value: window of the throttle in seconds
WINDOW_SECONDS = 60

KEYS = ["category", "identity"]


def limit_column(limits: Mapping[str, int]) -> Column:
    """Limit of the row's category; 0 (unlimited) for one without a limit."""
    limit = F.lit(0)
    for category, value in limits.items():
        limit = F.when(F.col("category") == category, value).otherwise(limit)
    return limit.cast("long")


def event_micros() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


class Verdicts:
    """Verdicts for the rows of one batch, filled run by run."""

    def __init__(self, rows: int) -> None:
        self.allowed = np.zeros(rows, dtype=bool)
        self.remaining = np.zeros(rows, dtype=np.int64)
        self.retry_after = np.zeros(rows, dtype=np.int64)

    def judge(self, at: np.ndarray, i: int, end: int, log: deque, limit: int, window: int) -> None:
        """Judge rows ``i`` to ``end``, events of one key at sorted times ``at``.

        ``log`` holds the allowed times still in the window and is updated.
        While it is full, all events up to the next free place are refused at
        once, so the steps taken grow with the allowed events only.
        """
        if limit <= 0:
            self.allowed[i:end] = True
            return
        while i < end:
            now = int(at[i])
            while log and log[0] <= now - window:
                log.popleft()
            if len(log) < limit:
                log.append(now)
                self.allowed[i], self.remaining[i] = True, limit - len(log)
                i += 1
                continue
            free = log[0] + window
            stop = i + int(np.searchsorted(at[i:end], free, "left"))
            self.retry_after[i:stop] = np.maximum(1, -((at[i:stop] - free) // MICROS))
            i = stop

    def beside(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(allowed=self.allowed, remaining=self.remaining, retry_after=self.retry_after)


def with_idle_segments(events: DataFrame, window: int, range_rows: int) -> DataFrame:
    """Add ``segment``: a new one after each window-long slot without events.

    Nothing allowed before such a pause counts after it, so the segments of a
    key are independent and a busy key spreads over many tasks.
    """
    slotted = events.withColumn("slot", F.floor(F.col("at") / window))
    slots = slotted.select(*KEYS, "slot").distinct()
    before = slots.select(*KEYS, (F.col("slot") + 1).alias("slot"), F.lit(0).cast("long").alias("starts"))
    marked = join_on(slots, before, [*KEYS, "slot"], "left").fillna(1, ["starts"])
    segments = running_sums(marked, [("slot", True)], {"starts": "segment"}, KEYS, range_rows)
    return join_on(slotted, segments.drop("starts"), [*KEYS, "slot"]).drop("slot")


def throttle(
    events: DataFrame, limits: Mapping[str, int], window_seconds: float = WINDOW_SECONDS, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """``(event_id, category, identity, allowed, remaining, retry_after)`` per event.

    Each segment is one sorted run of rows; a task keeps only the allowed
    times of the segment it is reading. The rule is sequential, so a key that
    never pauses for a window stays one run.
    """
    window = int(window_seconds * MICROS)
    timed = events.select("event_id", *KEYS, event_micros().alias("at"), limit_column(limits).alias("limit"))
    runs = [*KEYS, "segment"]
    ordered = (
        with_idle_segments(timed, window, range_rows)
        .repartition(*runs)
        .sortWithinPartitions(*runs, "at", "event_id")
    )

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, log = None, deque()
        for batch in batches:
            keys = batch[runs]
            before = keys.shift()
            # null is a key like any other; a segment is never null, so the first row starts a run
            same = (keys == before) | (keys.isna() & before.isna())
            starts = np.flatnonzero(~same.all(axis=1).to_numpy())
            at, limit = batch["at"].to_numpy(), batch["limit"].to_numpy()
            verdicts = Verdicts(len(keys))
            for start, end in zip(starts, [*starts[1:], len(keys)]):
                key = tuple(None if pd.isna(part) else part for part in keys.iloc[start])
                if key != run:
                    run, log = key, deque()
                verdicts.judge(at, start, end, log, int(limit[start]), window)
            yield verdicts.beside(batch[["event_id", *KEYS]])

    return ordered.mapInPandas(judge, output_schema(events))


def output_schema(events: DataFrame) -> T.StructType:
    fields = [events.schema[name] for name in ("event_id", *KEYS)]
    added = "allowed boolean, remaining long, retry_after long"
    return T.StructType([*fields, *T.StructType.fromDDL(added).fields])


class SlidingLog:
    """The throttle as a rule over the events of a key in time order; remembers the allowed times in the window."""

    state = "allowed array<long>"

    def __init__(self, limits: Mapping[str, int], window: int) -> None:
        self.limits, self.window = dict(limits), window

    def begin(self) -> tuple:
        return ([],)

    def apply(self, key: tuple, state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        log, verdicts = deque(state[0]), Verdicts(len(rows))
        verdicts.judge(rows["at"].to_numpy(), 0, len(rows), log, self.limits.get(key[0], 0), self.window)
        out = pd.DataFrame({"event_id": rows["event_id"], "category": key[0], "identity": key[1]})
        return (list(log),), verdicts.beside(out)

    def until(self, state: tuple) -> int:
        return state[0][-1] + self.window if state[0] else 0


def throttle_stream(
    events: DataFrame,
    limits: Mapping[str, int],
    window_seconds: float = WINDOW_SECONDS,
    delay: str = "0 seconds",
    slot_seconds: int = SLOT_SECONDS,
) -> DataFrame:
    """The same verdicts over a stream.

    Events wait in the state, in slots of ``slot_seconds``, until the watermark
    passes them and are then judged in time order. Later ones are dropped and
    counted by Spark. A key whose last allowed event has left the window has no state.
    """
    timed = events.select("event_id", *KEYS, F.col("ts").cast("timestamp").alias("ts"), event_micros().alias("at"))
    rule = SlidingLog(limits, int(window_seconds * MICROS))
    return apply_in_order(timed, KEYS, "event_id", rule, output_schema(events), delay, slot_seconds)
