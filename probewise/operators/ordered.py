"""Running sums, row numbers and quantiles over a whole ordered table.

A window without a partition key, or with one hot key, runs in one task. Here
the order is cut into ranges of about equal size, each range is summed on its
own, and the total of the ranges before it is added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probewise.session import durable

RANGE_ROWS = 1_000_000
# ranges that one expression tells apart; it does not limit their number
LISTED_RANGES = 512
SAMPLE_PER_RANGE = 64
HASH_SPACE = 1 << 31

OrderKey = tuple[str, bool]  # column name, ascending?


def order_columns(order: Sequence[OrderKey]) -> list[Column]:
    return [F.col(name).asc() if asc else F.col(name).desc() for name, asc in order]


def join_on(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null is a key like any other; the key columns come from ``left``."""
    keys = {name: f"_on_{name}" for name in by}
    match = F.lit(True)
    for name, other in keys.items():
        match = match & F.col(name).eqNullSafe(F.col(other))
    return left.join(right.withColumnsRenamed(keys), match, how).drop(*keys.values())


def range_cuts(df: DataFrame, order: Sequence[OrderKey], ranges: int, rows: int) -> list[tuple]:
    """Order-key values that split the ``rows`` of ``df`` into about ``ranges`` even ranges.

    Only a hash sample of about ``SAMPLE_PER_RANGE`` keys a range reaches the
    driver. Order keys must not be null.
    """
    names = [name for name, _ in order]
    keep = int(HASH_SPACE * min(1.0, ranges * SAMPLE_PER_RANGE / rows))
    sample = [
        tuple(row)
        for row in df.select(*names)
        .where(F.pmod(F.xxhash64(*names), F.lit(HASH_SPACE)) < keep)
        .distinct()
        .collect()
    ]
    for position, (_, asc) in reversed(list(enumerate(order))):
        sample.sort(key=lambda key, p=position: key[p], reverse=not asc)
    step = max(1, len(sample) // ranges)
    return sample[step::step][: ranges - 1]


def range_of(order: Sequence[OrderKey], cuts: list[tuple]) -> Column:
    """Number of the range a row falls in: a binary search over ``cuts``."""

    def before(cut: tuple) -> Column:
        result = F.lit(False)
        for (name, asc), value in reversed(list(zip(order, cut))):
            key, bound = F.col(name), F.lit(value)
            result = (key < bound if asc else key > bound) | ((key == bound) & result)
        return result

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(before(cuts[middle]), search(low, middle)).otherwise(search(middle + 1, high))

    return search(0, len(cuts))


def in_ranges(df: DataFrame, order: Sequence[OrderKey], range_rows: int = RANGE_ROWS) -> DataFrame | None:
    """``df`` with ``_range``, as many ranges as its rows ask for; None if one will do.

    Up to ``LISTED_RANGES`` of them are told apart by one expression. Beyond, Spark
    deals the rows out by its own sample, and they are saved with their range.
    """
    rows = df.count()
    ranges = -(-rows // range_rows)
    if ranges <= 1:
        return None
    if ranges > LISTED_RANGES:
        dealt = df.repartitionByRange(ranges, *order_columns(order))
        return durable(dealt.withColumn("_range", F.spark_partition_id()))
    return df.withColumn("_range", range_of(order, range_cuts(df, order, ranges, rows)))


def running_sums(
    df: DataFrame,
    order: Sequence[OrderKey],
    sums: dict[str, str],
    by: Sequence[str] = (),
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Add inclusive running sums: ``sums`` maps an input column to its output name.

    Rows equal on every order key get sums in no fixed order, so the order
    should end in a unique key. ``df`` is read more than once; pass a durable
    one where it is dear to compute.
    """
    ranged = in_ranges(df, order, range_rows)
    by = list(by)
    upto = (Window.unboundedPreceding, Window.currentRow)
    if ranged is None:
        window = Window.partitionBy(*by).orderBy(*order_columns(order)).rowsBetween(*upto)
        return df.withColumns({out: F.sum(name).over(window) for name, out in sums.items()})

    window = Window.partitionBy(*by, "_range").orderBy(*order_columns(order)).rowsBetween(*upto)
    within = ranged.withColumns({out: F.sum(name).over(window) for name, out in sums.items()})
    # one row per group and range
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(name).alias(f"_t_{out}") for name, out in sums.items()])
    offsets = totals.select(
        *by,
        "_range",
        *[F.coalesce(F.sum(f"_t_{out}").over(earlier), F.lit(0)).alias(f"_o_{out}") for out in sums.values()],
    )
    match = F.col("a._range") == F.col("o._range")
    for name in by:
        match = match & F.col(f"a.{name}").eqNullSafe(F.col(f"o.{name}"))
    joined = within.alias("a").join(offsets.alias("o"), match)
    return joined.select(
        *[F.col(f"a.{name}") for name in df.columns],
        *[(F.col(f"a.{out}") + F.col(f"o._o_{out}")).alias(out) for out in sums.values()],
    )


def row_numbers(
    df: DataFrame,
    order: Sequence[OrderKey],
    by: Sequence[str] = (),
    name: str = "row_no",
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Add a 1-based position in ``order``, per ``by`` group if given."""
    counted = running_sums(df.withColumn("_one", F.lit(1).cast("long")), order, {"_one": name}, by, range_rows)
    return counted.drop("_one")


def exact_quantiles(
    df: DataFrame,
    value: str,
    fractions: Sequence[float],
    by: Sequence[str] = (),
    method: str = "linear",
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Exact quantiles ``(by…, fraction, value)``.

    ``linear`` interpolates between neighbours; ``nearest`` takes the value at
    position ``round((n - 1) * fraction)`` with halves to even.
    """
    keys = list(by) or ["_all"]
    df = df if by else df.withColumn("_all", F.lit(0))
    counts = durable(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")))
    ranked = running_sums(counts, [(value, True)], {"_n": "_upto"}, keys, range_rows)
    totals = counts.groupBy(*keys).agg((F.sum("_n") - 1).alias("_last"))
    wanted = totals.withColumn("fraction", F.explode(F.array(*[F.lit(float(q)) for q in fractions])))
    place = F.col("_last") * F.col("fraction")
    if method == "nearest":
        wanted = wanted.withColumn("_low", F.bround(place, 0).cast("long")).withColumn("_high", F.col("_low"))
    else:
        wanted = wanted.withColumn("_low", F.floor(place)).withColumn("_high", F.ceil(place))
    wanted = wanted.withColumn("_part", place - F.col("_low"))

    def holds(position: str) -> Column:
        at = F.col(position)
        return (F.col("_upto") - F.col("_n") <= at) & (at < F.col("_upto"))

    # without groups `wanted` is one row per fraction; with groups Spark sizes the join
    pairs = join_on(ranked, wanted if by else F.broadcast(wanted), keys)
    ends = (
        pairs.where(holds("_low") | holds("_high"))
        .groupBy(*keys, "fraction", "_part")
        .agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    )
    result = F.col("_a") if method == "nearest" else F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")
    return ends.select(*by, "fraction", result.alias(value))
