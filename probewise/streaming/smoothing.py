"""Label smoothing over the frames of a live session.

Frames are ``(session, ts, frame_id, pipeline, decision, label, score,
threshold)``. A label becomes stable when the last five frames agree on it
often enough, and a stable label survives three misses.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from probewise.operators.ordered import RANGE_ROWS, row_numbers, running_sums
from probewise.streaming.keyed import SLOT_SECONDS, apply_in_order

# fixed values of the smoothing rule
HISTORY = 5
DROP_AFTER = 4
CUSTOM_MIN_SCORE = 0.30
CUSTOM_STEPS = ((2, 0.34), (3, 0.26))
OTHER_COUNT = 2

# rows of one piece of a session, and rows repeated from the piece before
PIECE_ROWS = 1_000_000
OVERLAP = HISTORY - 1 + DROP_AFTER


def candidate_columns() -> tuple[Column, Column]:
    """Label and score a frame offers; null where it offers none."""
    required = F.greatest("threshold", F.when(F.col("pipeline") == "custom", CUSTOM_MIN_SCORE).otherwise(F.col("threshold")))
    offers = (
        (F.lower("decision") == "match") & (F.coalesce("label", F.lit("")) != "") & (F.col("score") >= required)
    )
    return F.when(offers, F.col("label")), F.when(offers, F.col("score"))


def agreed_label(history: Column, pipeline: Column) -> Column:
    """Label the history agrees on: higher best score first, then the label."""
    offered = F.filter(history, lambda h: h["c"].isNotNull())

    def describe(label: Column) -> Column:
        own = F.filter(offered, lambda h: h["c"] == label)
        return F.struct((-F.array_max(F.transform(own, lambda h: h["s"]))).alias("m"), label.alias("c"), F.size(own).alias("n"))

    described = F.transform(F.array_distinct(F.transform(offered, lambda h: h["c"])), describe)

    def stable(d: Column) -> Column:
        custom = F.lit(False)
        for count, score in CUSTOM_STEPS:
            custom = custom | ((d["n"] >= count) & (-d["m"] >= score))
        return F.when(pipeline == "custom", custom).otherwise(d["n"] >= OTHER_COUNT)

    return F.array_min(F.filter(described, stable))["c"]


def stabilize_labels(
    frames: DataFrame, piece_rows: int = PIECE_ROWS, range_rows: int = RANGE_ROWS, idle_seconds: float | None = None
) -> DataFrame:
    """``(session, frame_id, stable_label)`` per frame.

    After a pause of more than ``idle_seconds`` a session starts anew.

    Sessions are cut into pieces that repeat the few rows the history needs.
    From a frame whose history agrees, or after four empty frames, the outcome
    no longer depends on anything earlier, so the held label is followed
    within such segments only.
    """
    label, score = candidate_columns()
    offered = frames.select("session", "ts", "frame_id", "pipeline", label.alias("c"), score.alias("s"))
    numbered = row_numbers(offered, [("ts", True), ("frame_id", True)], ["session"], "n", range_rows)
    piece = F.floor((F.col("n") - 1) / piece_rows)
    repeats = (F.col("n") - 1) % piece_rows >= piece_rows - OVERLAP
    pieces = numbered.withColumn("own", piece).withColumn(
        "piece", F.explode(F.when(repeats, F.array(piece, piece + 1)).otherwise(F.array(piece)))
    )
    in_piece = Window.partitionBy("session", "piece").orderBy("n")
    if idle_seconds is None:
        pieces = pieces.withColumns({"anew": F.lit(False), "visit": F.lit(0).cast("long")})
    else:
        at = F.unix_micros(F.col("ts").cast("timestamp"))
        paused = F.coalesce(at - F.lag(at).over(in_piece) > F.lit(int(idle_seconds * 1_000_000)), F.lit(False))
        visit = F.sum(F.col("anew").cast("long")).over(in_piece.rowsBetween(Window.unboundedPreceding, 0))
        pieces = pieces.withColumn("anew", paused).withColumn("visit", visit)
    recent = F.collect_list(F.struct("c", "s", "visit")).over(in_piece.rowsBetween(-(HISTORY - 1), 0))
    history = F.filter("recent", lambda h: h["visit"] == F.col("visit"))
    agreed = pieces.withColumn("recent", recent).withColumn("agreed", agreed_label(history, F.col("pipeline")))
    empty = (F.col("agreed").isNull() & F.col("c").isNull()).cast("int")
    empties = F.sum(empty).over(in_piece.rowsBetween(-(DROP_AFTER - 1), 0))
    marked = agreed.withColumn(
        "starts", (F.col("agreed").isNotNull() | (empties == DROP_AFTER) | F.col("anew")).cast("long")
    ).where("piece = own")
    segments = running_sums(
        marked.select("session", "frame_id", "n", "c", "agreed", "starts"),
        [("n", True)],
        {"starts": "segment"},
        ["session"],
        range_rows,
    )
    in_segment = Window.partitionBy("session", "segment").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    held = F.first("agreed").over(in_segment)
    last_hit = F.max(F.when(F.col("agreed").isNotNull() | (F.col("c") == F.col("held")), F.col("n"))).over(in_segment)
    followed = segments.withColumn("held", held).withColumn("misses", F.col("n") - last_hit)
    worst = F.max("misses").over(in_segment)
    return followed.withColumn("worst", worst).select(
        "session", "frame_id", F.when(F.col("worst") < DROP_AFTER, F.col("held")).alias("stable_label")
    )


def next_label(history: list, held: str | None, misses: int, offer: tuple | None, custom: bool) -> tuple:
    """One frame of the rule: returns (history, held, misses, shown label)."""
    history = [*history, offer][-HISTORY:]
    best = {}
    for label, score in filter(None, history):
        count, top = best.get(label, (0, score))
        best[label] = (count + 1, max(top, score))

    def stable(count: int, top: float) -> bool:
        return any(count >= c and top >= s for c, s in CUSTOM_STEPS) if custom else count >= OTHER_COUNT

    agreed = min(((-top, label) for label, (count, top) in best.items() if stable(count, top)), default=None)
    if agreed is not None:
        return history, agreed[1], 0, agreed[1]
    if held is None:
        return history, None, 0, None
    misses = 0 if offer and offer[0] == held else misses + 1
    return (history, held, misses, held) if misses < DROP_AFTER else (history, None, 0, None)


class HeldLabel:
    """The rule over the frames of a session in time order; remembers the last offers and the held label.

    After a pause of more than ``idle`` microseconds it starts anew.
    """

    state = "labels array<string>, scores array<double>, held string, misses int, last long"

    def __init__(self, idle: int | None) -> None:
        self.idle = idle

    def begin(self) -> tuple:
        return ([], [], None, 0, None)

    def apply(self, key: tuple, state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        labels, scores, held, misses, last = state
        history = [None if label is None else (label, score) for label, score in zip(labels, scores)]
        shown = []
        for at, label, score, pipeline in rows[["at", "c", "s", "pipeline"]].itertuples(index=False, name=None):
            if self.idle is not None and last is not None and at - last > self.idle:
                history, held, misses = [], None, 0
            offer, last = None if pd.isna(label) else (label, float(score)), int(at)
            history, held, misses, now = next_label(history, held, misses, offer, pipeline == "custom")
            shown.append(now)
        pairs = [offer or (None, None) for offer in history]
        out = pd.DataFrame({"session": key[0], "frame_id": rows["frame_id"], "stable_label": shown})
        return ([p[0] for p in pairs], [p[1] for p in pairs], held, misses, last), out

    def until(self, state: tuple) -> int | None:
        return None if self.idle is None or state[4] is None else state[4] + self.idle


def stabilize_stream(
    frames: DataFrame, delay: str | None = None, idle_seconds: float | None = None, slot_seconds: int = SLOT_SECONDS
) -> DataFrame:
    """The same rule over a stream of frames.

    Without a ``delay`` frames must come in time order from trigger to trigger.
    With one they wait until the watermark passes them, and the state of a session
    that is silent for ``idle_seconds`` is removed. A task holds the frames of a
    session in one slot of ``slot_seconds``.
    """
    label, score = candidate_columns()
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    offered = frames.select(
        "session", F.col("ts").cast("timestamp").alias("ts"), at.alias("at"), "frame_id", "pipeline", label.alias("c"), score.alias("s")
    )
    schema = T.StructType(
        [frames.schema["session"], frames.schema["frame_id"], T.StructField("stable_label", T.StringType())]
    )
    rule = HeldLabel(None if idle_seconds is None else int(idle_seconds * 1_000_000))
    return apply_in_order(offered, ["session"], "frame_id", rule, schema, delay, slot_seconds)
