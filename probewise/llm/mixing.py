"""Mixing sources to target weights along a curriculum that changes over the run.

A source's weight is a schedule: straight lines between knots over the run, from
time 0 to 1. Its integral up to a time, scaled to the source's target, is what
the run has asked of the source by then. Documents stand in a source in a
hashed order; the words before a document are its place in the source's stream,
read from the start again when it ends. Inverting the integral at that place
gives the time at which the document is read, and the mix is sorted by it; each
further reading has its own place, a whole source behind the one before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probewise.llm.common import mixed_order, query, read, running_total, word_count
from probewise.operators.ordered import row_numbers, running_sums
from probewise.session import durable

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: Relative weight over the run of the sources of each weight: heavy ones early, light ones late.
RAMPS = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
SHARE = 1.5
LIMIT = 2.0

Knots = Sequence[tuple[float, float]]


def pieces(knots: Knots) -> list[tuple[float, float, float, float, float, float]]:
    """``(t0, t1, w0, w1, area before, area up to t1)`` of each straight line, area 1 in all."""
    area = [(t0, t1, w0, w1, (t1 - t0) * (w0 + w1) / 2) for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    whole, done, out = sum(a[-1] for a in area), 0.0, []
    for t0, t1, w0, w1, own in area:
        out.append((t0, t1, w0 / whole, w1 / whole, done, done + own / whole))
        done += own / whole
    return out


def time_of(part: Column, knots: Knots) -> Column:
    """The time at which the schedule has asked for ``part`` (0 to 1) of its whole."""
    result = F.lit(float(knots[-1][0]))
    for t0, t1, w0, w1, before, upto in reversed(pieces(knots)):
        rest, slope = part - before, (w1 - w0) / (t1 - t0)
        # w0 * x + slope / 2 * x ** 2 = rest, in the form that stays exact for flat lines
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0)))
        x = F.when(rest <= 0, F.lit(0.0)).otherwise(2 * rest / (F.lit(w0) + root))
        result = F.when(part <= upto, F.lit(t0) + x).otherwise(result)
    return result


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """``(source, rank, kind, source_size, target)``: shares by weight, none above ``limit`` times its source.

    Sources stand by code point, null last. Where shares are cut at the limit
    and the excess goes to the others by weight until none is above, the rest
    get one common multiple of their weight; sorting by size over weight finds
    it with running sums.
    """
    totals = durable(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    keyed = totals.select("*", F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_name"))
    ranked = row_numbers(keyed, [("_none", True), ("_name", True)], name="rank")
    kind = ((F.col("rank") - 1) % len(weights)).cast("int")
    weighed = durable(
        ranked.select(
            "source",
            "rank",
            kind.alias("kind"),
            "source_size",
            F.get(F.array(*[F.lit(float(w)) for w in weights]), kind).alias("w"),
            (F.col("source_size") * limit).alias("cap"),
        ).withColumn("level", F.col("cap") / F.col("w"))
    )
    whole = weighed.agg((F.sum("source_size") * share).alias("all"), F.sum("w").alias("all_w"))
    sums = running_sums(weighed, [("level", True), ("rank", True)], {"cap": "caps", "w": "ws"})
    # a source is cut where even its own level asks for no more than there is to share
    asked = F.col("caps") + F.col("level") * (F.col("all_w") - F.col("ws"))
    cut = sums.crossJoin(F.broadcast(whole)).withColumn("is_cut", asked <= F.col("all"))
    level = cut.agg(
        F.first("all").alias("all"),
        F.first("all_w").alias("all_w"),
        F.coalesce(F.sum(F.when(F.col("is_cut"), F.col("cap"))), F.lit(0.0)).alias("cut_cap"),
        F.coalesce(F.sum(F.when(F.col("is_cut"), F.col("w"))), F.lit(0.0)).alias("cut_w"),
    ).select(F.when(F.col("all_w") > F.col("cut_w"), (F.col("all") - F.col("cut_cap")) / (F.col("all_w") - F.col("cut_w"))).otherwise(0.0).alias("common"))
    target = F.when(F.col("is_cut"), F.col("cap")).otherwise(F.least("cap", F.col("common") * F.col("w")))
    return cut.crossJoin(F.broadcast(level)).select("source", "rank", "kind", "source_size", target.alias("target"))


def position_of(part: Column, ramps: Sequence[Knots]) -> Column:
    """The time at which a source of ``kind`` has been asked for ``part`` (0 to 1) of its target."""
    position = F.lit(None).cast("double")
    for i, knots in enumerate(ramps):
        position = F.when(F.col("kind") == i, time_of(part, knots)).otherwise(position)
    return position


def placed(
    docs: DataFrame,
    size: Column | None = None,
    key: str = "doc_id",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    limit: float = LIMIT,
    whole: bool = False,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """What ``mix`` says of the documents but for the position, with ``kind`` and ``_at``, the words before a document."""
    size = word_count(F.col("text")) if size is None else size
    carry = carry or {}
    sizes = docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), size.alias("size"), *[c.alias(f"_c_{name}") for name, c in carry.items()])
    sized = durable(sizes.withColumn("_h", mixed_order(F.col("_key"))))
    targets = durable(source_targets(sized, weights, share, limit))
    rows = sized.count()
    # few sources: Spark sends them to the documents where it finds them small
    names = F.col("d.source").eqNullSafe(F.col("t.source"))
    joined = sized.alias("d").join(targets.alias("t"), names).select("d.*", "t.rank", "t.kind", "t.source_size", "t.target")
    summed = running_total(joined, ["rank"], "_h", ["_key", "size"], "size", "_at", rows)
    asked = F.round("target").cast("long")
    turns = F.when(F.col("source_size") > 0, F.floor(asked / F.col("source_size"))).otherwise(0).cast("long")
    rest = asked - F.col("_turns") * F.col("source_size")
    over = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_at")))
    if whole:
        over = F.when(2 * over >= F.col("size"), F.col("size")).otherwise(0)
    known = summed.withColumn("_turns", turns).withColumn("_over", over.cast("long"))
    return known.select(
        F.col("_key").alias(key),
        "size",
        "source_size",
        "target",
        (F.col("_turns") + F.when((F.col("_over") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0)).alias("copies"),
        (F.col("_turns") * F.col("size") + F.col("_over")).alias("taken"),
        "kind",
        "_at",
        *[F.col(f"_c_{name}").alias(name) for name in carry],
    )


def mix(
    docs: DataFrame,
    size: Column | None = None,
    key: str = "doc_id",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    ramps: Sequence[Knots] = RAMPS,
    share: float = SHARE,
    limit: float = LIMIT,
    whole: bool = False,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per document: ``key, size, source_size, target, copies, taken, position``.

    ``copies`` whole readings, and in ``taken`` also the words of a last,
    partial one where the target ends inside a document; with ``whole`` that
    reading is taken whole or not at all, by where its middle lies.
    ``position`` is the time (0 to 1) of the first reading, null if there is
    none. Null texts have size 0 and are never taken; a null source is a source
    of its own; rows with equal keys are ordered by size, and rows equal in
    both share one set of places in any order. ``carry`` names further columns
    of ``docs`` to keep. Readings end at ``limit`` times a document.
    """
    known = placed(docs, size, key, source, weights, share, limit, whole, carry)
    first = F.when(F.col("taken") > 0, F.round(position_of(F.col("_at") / F.col("target"), ramps), 6))
    return known.select(key, "size", "source_size", "target", "copies", "taken", first.alias("position"), *(carry or {}))


def in_order(mixed: DataFrame) -> DataFrame:
    """The mix by position: range-sorted, documents that are not taken last."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), *[c for c in mixed.columns if c != "position"][:1])


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` as often as the mix reads them, each reading at its own time, with their columns.

    Documents are taken whole. Only keys, sources and sizes take part in the
    mixing; rows that repeat key and text are taken alike.
    """
    places = placed(docs, key=key, whole=True, carry={"_t": F.xxhash64(text)}).where("copies > 0")
    # the source's stream starts again with every turn
    turns = F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)
    times = F.transform(turns, lambda turn: position_of((turn * F.col("source_size") + F.col("_at")) / F.col("target"), RAMPS))
    # of rows taken alike, the one that is read most often and then first
    most = F.min(F.struct((-F.col("copies")).alias("less"), times.alias("times")))
    taken = places.groupBy(F.col(key).alias("_k"), "_t").agg(most["times"].alias("_times"))
    match = F.col(key).eqNullSafe(F.col("_k")) & (F.xxhash64(text) == F.col("_t"))
    readings = docs.join(taken, match).select(*[docs[c] for c in docs.columns], F.posexplode("_times").alias("_turn", "_time"))
    return readings.orderBy("_time", F.col(key), "_turn").select(*[F.col(c) for c in docs.columns])


@query(
    "op9_mix_sources",
    r"""
    WITH d AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
               ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h
        FROM documents
    ), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM s),
    w AS (SELECT *, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[((rnk - 1) % 3 + 1)::INT] AS w, source_size * 2.0::DOUBLE AS cap FROM r),
    l AS (SELECT *, cap / w AS level FROM w),
    x AS (SELECT *, sum(cap) OVER o AS caps, sum(w) OVER o AS ws, sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(w) OVER () AS all_w
          FROM l WINDOW o AS (ORDER BY level, rnk ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT *, caps + level * (all_w - ws) <= total AS is_cut FROM x),
    k AS (SELECT CASE WHEN max(all_w) > coalesce(sum(w) FILTER (is_cut), 0)
                 THEN (max(total) - coalesce(sum(cap) FILTER (is_cut), 0)) / (max(all_w) - coalesce(sum(w) FILTER (is_cut), 0)) ELSE 0 END AS common FROM c),
    t AS (SELECT source, rnk, source_size, CASE WHEN is_cut THEN cap ELSE least(cap, common * w) END AS target FROM c, k),
    p AS (SELECT d.*, t.rnk, source_size, target,
                 coalesce(sum(size) OVER (PARTITION BY t.rnk ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(round(target) / source_size) ELSE 0 END::BIGINT AS turns, ahead / target AS part FROM p),
    z AS (SELECT *, (turns * size + greatest(0, least(size, round(target) - turns * source_size - ahead)))::BIGINT AS taken FROM q)
    SELECT doc_id, size, source_size, target, taken,
           CASE WHEN taken > 0 THEN round(CASE (rnk - 1) % 3
                WHEN 0 THEN 2 * part / (1.5 + sqrt(2.25 - 2 * part))
                WHEN 1 THEN part ELSE 2 * part / (0.5 + sqrt(0.25 + 2 * part)) END, 6) END AS position
    FROM z
    """,
)
def op9_mix_sources(spark, sf_dir):
    return in_order(mix(read(spark, sf_dir, "documents"))).drop("copies")
