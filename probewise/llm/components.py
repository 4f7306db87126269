"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probewise.llm.common import BROADCAST_ROWS, saved


def hook(pairs: DataFrame, small: bool, few: bool = False) -> DataFrame:
    """One star step: every neighbour of a node is linked to the smallest one.

    The large step moves the larger neighbours, the small step the smaller
    ones and the node itself. Only minima are gathered, so a node with any
    number of neighbours is no group in memory; those of ``few`` pairs are broadcast.
    """
    if small:
        edges = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        edges = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select(F.col("b"), F.col("a")))
    lowest = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = edges.join(F.broadcast(lowest) if few else lowest, "u")
    if small:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(lowest.select("u", "m"))
    else:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.where(F.col("a") != F.col("b")).distinct()


def connected(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of its component, for every node of ``links(a, b)`` but that one.

    Alternates large and small star steps, whose rounds grow with the logarithm
    of the longest path, until nothing changes. Loops and repeated links are
    harmless; no links give no rows.
    """
    pairs = saved(links.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    seen, few = None, False
    while True:
        pairs = saved(hook(hook(pairs, False, few), True, few))
        state = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen or state[0] == 0:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("label"))
        # a step has at most two nodes a pair, and one moved pair a pair and a node
        seen, few = state, 4 * state[0] <= BROADCAST_ROWS
