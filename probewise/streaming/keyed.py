"""Rules that need the rows of a key in time order, over a stream.

The rows of a key wait in map state, in parts, as they come: a batch is stored
and forgotten, whatever its size. Up to ``PART_ROWS`` waiting rows of a key are
parts of any times, since a call to the state costs more than a row; those of a
busier key are parts of one slot of event time. When the watermark passes rows,
a timer hands them to the rule, all at once or slot by slot, sorted, and their
parts are removed. So a task holds one batch, ``PART_ROWS`` rows or the rows of
one key and slot, a trigger rewrites no waiting rows but these, and late rows
find their place as long as they wait. Rows that need not wait are not stored
unless they are many. What the rule remembers of a key is one value, removed by
a timer once it means nothing more.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SLOT_SECONDS = 3600
# waiting rows of a key that are read and written together
PART_ROWS = 4096
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

CONVERT = {T.LongType(): int, T.IntegerType(): int, T.DoubleType(): float, T.StringType(): str}


class Rule(Protocol):
    """``state`` is the DDL of what the rule remembers of a key, ``begin()`` its first value."""

    state: str

    def begin(self) -> tuple: ...

    def apply(self, key: tuple, state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]: ...

    def until(self, state: tuple) -> int | None: ...


class InTimeOrder(StatefulProcessor):
    """Hands the rows ``fields`` of a key to ``rule`` by ``at`` (microseconds) and then ``tie``.

    If it ``waits`` for the watermark, rows may come in any order until that has
    passed them; otherwise the rows of each trigger are handed on at its end.
    ``rule.until`` tells the time from which a state means nothing more.
    """

    def __init__(self, fields: T.StructType, tie: str, rule: Rule, slot_seconds: int, waits: bool) -> None:
        self.fields, self.tie, self.rule, self.waits = fields, tie, rule, waits
        self.slot = slot_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        lists = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in self.fields])
        self.rows = handle.getMapState("rows", "slot long, part long", lists)
        self.kept = handle.getValueState("kept", f"parts long, waiting long, wake long, {self.rule.state}")

    def close(self) -> None:
        pass

    def known(self) -> tuple[int, int, int | None, tuple]:
        """The number of the next part, that of waiting rows, the time of the key's only timer, and what the rule remembers."""
        kept = self.kept.get()
        return (*kept[:3], tuple(kept[3:])) if kept else (0, 0, None, self.rule.begin())

    def store(self, slot: int, part: int, rows: pd.DataFrame) -> None:
        """A part of one slot; with a negative number, one of any times from this slot on."""

        def plain(field: T.StructField) -> list:
            convert = CONVERT.get(field.dataType, lambda x: x)
            return [None if pd.isna(x) else convert(x) for x in rows[field.name].tolist()]

        self.rows.updateValue((slot, part), tuple(plain(field) for field in self.fields))

    def store_slots(self, parts: int, rows: pd.DataFrame) -> int:
        """Store rows in parts of one slot each; the number of the next part."""
        for slot, part in rows.groupby(rows["at"] // self.slot, sort=False):
            self.store(int(slot), parts, part)
            parts += 1
        return parts

    def in_order(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows[self.fields.names].sort_values(["at", self.tie], ignore_index=True)

    def load(self, keys: list[tuple]) -> pd.DataFrame:
        columns: dict[str, list[Any]] = {name: [] for name in self.fields.names}
        for key in keys:
            for name, values in zip(columns, self.rows.getValue(key)):
                columns[name].extend(values)
            self.rows.removeKey(key)
        return self.in_order(pd.DataFrame(columns))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts, waiting, wake, state = self.known()
        first, held, size = None, [], 0
        for batch in rows:
            # rows without a time have no place in the order
            batch = batch[batch["at"].notna()].astype({"at": "int64"})
            if batch.empty:
                continue
            at = int(batch["at"].min())
            first = at if first is None else min(first, at)
            held.append(batch)
            size += len(batch)
            if waiting + size > PART_ROWS:
                for some in held:
                    parts = self.store_slots(parts, some)
                waiting, held, size = waiting + size, [], 0
        if held:
            some = pd.concat(held) if len(held) > 1 else held[0]
            if not self.waits and not waiting:
                state, out = self.rule.apply(key, state, self.in_order(some))
                self.kept.update((parts, 0, None, *state))
                yield out
                return
            self.store(int(some["at"].min()) // self.slot, -parts - 1, some)
            parts, waiting = parts + 1, waiting + size
        due = None if first is None else first // 1000 + 1
        if self.waits and due is not None and (wake is None or due < wake):
            if wake is not None:
                self.handle.deleteTimer(wake)
            self.handle.registerTimer(due)
            wake = due
        self.kept.update((parts, waiting, wake, *state))
        if not self.waits:
            yield from self.hand_on(key, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.hand_on(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def hand_on(self, key: tuple, passed: int | None) -> Iterator[pd.DataFrame]:
        """The verdicts for the rows up to ``passed``, or for all."""
        parts, waiting, wake, state = before = self.known()
        stored = sorted(tuple(k) for k in self.rows.keys()) if waiting else []
        few = waiting <= PART_ROWS
        if not few and any(part < 0 for _, part in stored):
            for mixed in [k for k in stored if k[1] < 0]:
                parts = self.store_slots(parts, self.load([mixed]))
            stored = sorted(tuple(k) for k in self.rows.keys())
        # the time of the first row that waits, or an earlier one
        later = None
        for slot, keys in groupby(stored, key=lambda k: stored[0][0] if few else k[0]):
            if passed is not None and slot * self.slot > passed:
                later = slot * self.slot if later is None else later
                break
            rows = self.load(list(keys))
            if passed is not None:
                ready = rows["at"] <= passed
                if not ready.all():
                    later = int(rows["at"][~ready].min())
                    self.store(later // self.slot if few else slot, -parts - 1 if few else parts, rows[~ready])
                    parts += 1
                rows = rows[ready]
            if len(rows):
                waiting -= len(rows)
                state, out = self.rule.apply(key, state, rows.reset_index(drop=True))
                yield out
        until = None if passed is None else self.rule.until(state)
        if later is None and until is not None and until <= passed:
            self.kept.clear()
            return
        then = until if later is None else later
        after = (0 if later is None else parts, waiting, None if then is None else then // 1000 + 1, state)
        # a timer that finds nothing to do leaves things as they are
        if after != before:
            self.kept.update((*after[:3], *state))
            if after[2] is not None:
                self.handle.registerTimer(after[2])


def apply_in_order(
    rows: DataFrame,
    keys: list[str],
    tie: str,
    rule: Rule,
    output: T.StructType,
    delay: str | None,
    slot_seconds: int = SLOT_SECONDS,
) -> DataFrame:
    """Apply a rule to the stream ``rows``: ``keys``, a timestamp ``ts``, the microseconds ``at``, ``tie`` and others.

    With a ``delay`` the rows wait until the watermark passes them. State is kept
    by RocksDB, which the session is set to.
    """
    spark = rows.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)
    fields = T.StructType([field for field in rows.schema if field.name not in (*keys, "ts")])
    timed = rows if delay is None else rows.withWatermark("ts", delay)
    processor = InTimeOrder(fields, tie, rule, slot_seconds, delay is not None)
    return timed.groupBy(*[F.col(name) for name in keys]).transformWithStateInPandas(
        processor, output, "append", "none" if delay is None else "eventtime"
    )
