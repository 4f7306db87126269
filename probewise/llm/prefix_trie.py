"""Prefix trie of conversations by whole-sequence collapse.

A node is a sequence of first turns, known by its depth and two sums of 64-bit
hashes of its turns and their places; sums add up along a conversation and
over its parts in any order, so texts are hashed where they are read and never
moved. Of a billion nodes any two are mistaken with a chance below ``1e-19``.

Equal conversations are one sequence with a weight and a list of the ones that
end there. Only the sequences are cut into prefixes. A sequence that is no
proper prefix of another one, found by an anti-join, is a leaf. Members and
leaves of a node are sums over the sequences that begin with it.

Sums over a subtree need no pairs of nodes and ancestors. Every node is owned
by the sequence of its smallest member, which runs through it. A sequence sums
the values of its own nodes from its end to each depth, and a node's subtree is
the sum of that over the sequences that begin with it.

Hot groups: a first turn that a third of all conversations share is aggregated
before the shuffle, a long conversation is cut into ranges (``ordered``), the
rows of a hot parent are a skewed join, which Spark splits, and the list of a
node's ends is made of pieces of at most ``1 << PIECE_BITS`` conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probewise.llm.common import query, read
from probewise.llm.periods import CRC32
from probewise.operators.ordered import row_numbers, running_sums
from probewise.session import durable

#: Conversations of a hundred neighbouring ids begin like the first of them, by 0 to 5 turns.
FAMILY, HEADS = 100, 6
#: A piece of a list of ends has the ids that are equal but for so many last bits.
PIECE_BITS = 12

NODE = ["depth", "s1", "s2"]


def hash_of(*values: Column) -> Column:
    return F.xxhash64(*values).cast("decimal(20,0)")


def ordered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, pos, c1, c2, chars``: places from 1, hashes of role and text, and the code points of the text.

    Turns are ordered by ``turn``, null first, and of equal number by hash. A null
    role or text is empty; rows without a conversation belong to none.
    """
    who, what = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv_id"),
        F.col(turn).isNull().alias("_none"),
        F.coalesce(F.col(turn), F.lit(0)).alias("_turn"),
        F.xxhash64(F.lit(1), who, what).alias("c1"),
        F.xxhash64(F.lit(2), who, what).alias("c2"),
        F.length(what).cast("long").alias("chars"),
    )
    order = [("_none", False), ("_turn", True), ("c1", True), ("c2", True)]
    return row_numbers(durable(rows), order, ["conv_id"], "pos").select("conv_id", "pos", "c1", "c2", "chars")


def with_shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns and all conversations: each begins with the first ``h`` turns of its family's first one.

    ``h`` is ``crc32(conv_id) mod 6``; the conversation's own first ``h`` turns
    give way. Fewer turns are taken where there are fewer. A family is the ids of
    equal quotient by a hundred, rounded towards zero.
    """
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    h = F.crc32(F.col("conv_id").cast("string")) % HEADS
    convs = durable(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns")))
    heads = durable(turns.where((F.col("conv_id") == first) & (F.col("pos") < HEADS)).withColumnRenamed("conv_id", "first"))
    there = heads.groupBy("first").agg(F.count(F.lit(1)).alias("there"))
    taken = F.least(h, F.coalesce("there", F.lit(0)))
    begun = (
        convs.select("conv_id", first.alias("first"), h.alias("h"))
        .join(heads, "first")
        .where(F.col("pos") <= F.col("h"))
        .select("conv_id", "pos", "c1", "c2", "chars")
    )
    own = (
        turns.where(F.col("pos") > h)
        .withColumn("first", first)
        .join(there, "first", "left")
        .select("conv_id", (F.col("pos") - h + taken).alias("pos"), "c1", "c2", "chars")
    )
    return begun.unionByName(own), convs.select("conv_id")


def sequences_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv_id`` and the node it ends at; a conversation without turns ends at the root."""
    ends = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("depth"), F.sum("a1").alias("s1"), F.sum("a2").alias("s2"))
    zero = F.lit(0).cast("decimal(30,0)")
    return convs.join(ends, "conv_id", "left").select(
        "conv_id",
        F.coalesce("depth", F.lit(0)).alias("depth"),
        *[F.coalesce(s, zero).alias(s) for s in ("s1", "s2")],
    )


def end_lists(ended: DataFrame, bits: int = PIECE_BITS) -> DataFrame:
    """``NODE`` and ``ends_sha256``: the SHA-256 of the ids that end there, ascending, joined by commas.

    Lists of one piece are hashed where they are; those of several are hashed
    piece by piece in their order, so none is ever held as a whole.
    """
    pieces = durable(
        ended.groupBy(*NODE, F.shiftright("conv_id", bits).alias("piece")).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
        )
    )
    counts = pieces.groupBy(*NODE).agg(F.count(F.lit(1)).alias("_n"), F.min("ids").alias("ids"))
    single = counts.where("_n = 1").select(*NODE, F.sha2(F.encode("ids", "UTF-8"), 256).alias("ends_sha256"))
    many = durable(counts.where("_n > 1").select(*NODE))
    if many.isEmpty():
        return single
    rows = pieces.join(many, NODE, "left_semi").repartition(*NODE).sortWithinPartitions(*NODE, "piece")
    schema = pa.schema([("depth", pa.int64()), ("s1", pa.decimal128(30)), ("s2", pa.decimal128(30)), ("ends_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            for depth, s1, s2, ids in zip(*(batch.column(name).to_pylist() for name in (*NODE, "ids"))):
                if (depth, s1, s2) == node:
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*node, state.hexdigest())))], schema)
                node, state = (depth, s1, s2), hashlib.sha256(ids.encode())
        if node is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*node, state.hexdigest())))], schema)

    return single.unionByName(rows.mapInArrow(digest, "depth long, s1 decimal(30,0), s2 decimal(30,0), ends_sha256 string"))


def prefix_trie(turns: DataFrame, convs: DataFrame, bits: int = PIECE_BITS) -> DataFrame:
    """The nodes of all conversations ``convs`` with the turns ``turns(conv_id, pos, c1, c2, chars)``.

    One row per distinct sequence of first turns: ``conv_id`` (smallest member),
    ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``. A node's own saving is the code points
    of its last text times its members but one; subtrees are with their top.
    ``node_texts`` gives the role and text. No conversations, no nodes.
    """
    hashed = turns.select(
        "conv_id",
        "pos",
        hash_of(F.lit(3), "pos", "c1", "c2").alias("a1"),
        hash_of(F.lit(4), "pos", "c1", "c2").alias("a2"),
        "chars",
    )
    hashed = durable(hashed)
    ended = durable(sequences_of(hashed, convs))
    # equal conversations become one sequence, told by its smallest one
    sequences = durable(ended.groupBy(*NODE).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("weight")))

    told = sequences.select(F.col("rep").alias("conv_id"), "weight", F.col("depth").alias("length"))
    zero = F.lit(0).cast("decimal(30,0)")
    sums = running_sums(durable(hashed.join(told, "conv_id")), [("pos", True)], {"a1": "s1", "a2": "s2"}, ["conv_id"])
    below = sums.select(
        F.col("conv_id").alias("rep"), "weight", "length", F.col("pos").alias("depth"), "s1", "s2", "chars",
        *[(F.col(f"s{i}") - F.col(f"a{i}")).cast("decimal(30,0)").alias(f"p{i}") for i in (1, 2)],
    )
    root = sequences.select(
        "rep", "weight", F.col("depth").alias("length"), F.lit(0).cast("long").alias("depth"), zero.alias("s1"), zero.alias("s2"),
        F.lit(0).cast("long").alias("chars"), F.lit(None).cast("decimal(30,0)").alias("p1"), F.lit(None).cast("decimal(30,0)").alias("p2"),
    )
    prefixes = durable(below.unionByName(root))

    # sequences that others go on from are no leaves
    proper = prefixes.where(F.col("depth") < F.col("length")).select(*NODE).distinct()
    leaves = sequences.join(proper, NODE, "left_anti").select("rep", F.lit(1).cast("long").alias("leaf"))
    nodes = durable(
        prefixes.join(leaves, "rep", "left")
        .groupBy(*NODE)
        .agg(
            F.min("rep").alias("conv_id"),
            F.sum("weight").alias("n_convs"),
            F.coalesce(F.sum("leaf"), F.lit(0)).alias("n_leaves"),
            F.max("chars").alias("chars"),
            F.max("p1").alias("p1"),
            F.max("p2").alias("p2"),
        )
    )

    # a node's saving stands on the sequence of its smallest member, and is summed from the end
    saved = nodes.select(F.col("conv_id").alias("rep"), "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("own"))
    placed = durable(prefixes.select("rep", *NODE).join(saved, ["rep", "depth"], "left").withColumn("own", F.coalesce("own", F.lit(0))))
    subtrees = (
        running_sums(placed, [("depth", False)], {"own": "saved"}, ["rep"])
        .groupBy(*NODE)
        .agg(F.sum("saved").alias("saved_tokens"))
    )
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("s1"), F.col("p2").alias("s2"))
    children = children.agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("s1").alias("p1"), F.col("s2").alias("p2"), F.col("conv_id").alias("parent_conv_id")
    )
    return (
        nodes.join(subtrees, NODE)
        .join(children, NODE, "left")
        .join(end_lists(ended, bits), NODE, "left")
        .join(parents, ["depth", "p1", "p2"], "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )


def node_texts(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """``nodes`` with the last turn of each, any columns of ``turns(conv_id, pos, ...)``; null at the root."""
    return nodes.join(turns.withColumnRenamed("pos", "depth"), ["conv_id", "depth"], "left")


@query(
    "op12_prefix_trie",
    f"""
    WITH turns AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
        FROM conversations WHERE conv_id IS NOT NULL
    ), own AS (
        SELECT conv_id, list(struct_pack(role, text) ORDER BY pos) AS seq, {CRC32.format("conv_id")} % 6 AS h FROM turns GROUP BY conv_id
    ), rebuilt AS (
        SELECT o.conv_id, list_concat(coalesce(b.seq[1:o.h], []), o.seq[o.h + 1:]) AS seq
        FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100
    ), paths AS (
        SELECT conv_id, seq, len(seq) AS n, unnest(range(len(seq) + 1)) AS depth FROM rebuilt
    ), nodes AS (
        SELECT seq[1:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
               sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
        FROM paths GROUP BY ALL
    ), tree AS (
        SELECT c.*, p.conv_id AS parent_conv_id, CASE WHEN c.depth > 0 THEN (c.n_convs - 1) * length(c.prefix[c.depth].text) ELSE 0 END AS own
        FROM nodes c LEFT JOIN nodes p ON c.depth = p.depth + 1 AND c.prefix[1:p.depth] = p.prefix
    ), children AS (
        SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM tree WHERE depth > 0 GROUP BY ALL
    ), below AS (
        SELECT v.conv_id, v.depth, sum(u.own)::BIGINT AS saved_tokens, count(*) FILTER (c.n_children IS NULL) AS n_leaves
        FROM tree v JOIN tree u ON u.depth >= v.depth AND u.prefix[1:v.depth] = v.prefix
        LEFT JOIN children c ON c.conv_id = u.conv_id AND c.depth = u.depth
        GROUP BY ALL
    )
    SELECT t.conv_id, t.depth, t.parent_conv_id, t.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, ends_sha256
    FROM tree t JOIN below USING (conv_id, depth) LEFT JOIN children USING (conv_id, depth)
    """,
)
def op12_prefix_trie(spark, sf_dir):
    return prefix_trie(*with_shared_heads(ordered_turns(read(spark, sf_dir, "conversations"))))
