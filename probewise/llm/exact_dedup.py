"""Exact duplicates by composable polynomial fingerprints, settled by comparing the chunks.

A text is read as UTF-8 bytes in chunks. A chunk's hash is the value of its
bytes as a polynomial, under two moduli; hashes of neighbours combine as
``h(a + b) = h(a) * base ** len(b) + h(b)``, so chunks are hashed on their own:
those of a huge document are rows that any task hashes, and their hashes are
combined in order. A text is in memory where it is read and cut, its chunks one
by one after that. Texts
of equal fingerprint and length are then compared chunk by chunk: the smallest
and the largest chunk at each place must be the same. Spark finds these two
before and after the shuffle, so a group of copies that holds a third of all
rows sends one copy a task. A group whose chunks differ (a collision of the
fingerprint) is divided by the SHA-256 of the texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probewise.llm.common import lower_ascii, query, read, sized
from probewise.session import durable

#: Moduli and bases of the two polynomials.
MODULI = ((2_147_483_647, 1_000_003), (2_147_483_629, 998_244_353))
CHUNK_BYTES = 1 << 16
#: The chunks of texts of this many bytes are rows of their own, dealt to all tasks.
LONG_BYTES = 1 << 22

KEY = ["f1", "f2", "n_bytes"]


def powers(modulus: int, base: int, n: int) -> np.ndarray:
    """``base ** (n - 1), ..., base, 1`` under the modulus."""
    out = np.empty(n, np.int64)
    value = 1
    for i in range(n - 1, -1, -1):
        out[i] = value
        value = value * base % modulus
    return out


def combine(left: int, right: int, shift: int, modulus: int) -> int:
    """The hash of two neighbours; ``shift`` is ``base ** len(right)``."""
    return (left * shift + right) % modulus


def fingerprint(data: bytes, tables: list[tuple[int, int, np.ndarray]], chunk: int) -> list[int]:
    """The polynomial hash of ``data`` under each modulus, chunk by chunk."""
    values = np.frombuffer(data, np.uint8)
    out = []
    for modulus, base, table in tables:
        total = 0
        for at in range(0, len(values), chunk):
            part = values[at : at + chunk].astype(np.int64)
            # at most 2**8 * 2**31 * 2**16 per sum, far below 2**63
            own = int(np.dot(part + 1, table[len(table) - len(part) :])) % modulus
            total = combine(total, own, pow(base, len(part), modulus), modulus)
        out.append(total)
    return out


def fingerprints(moduli=MODULI, chunk: int = CHUNK_BYTES):
    """A column function: text to ``struct(f1, f2, n_bytes)``; null for null."""

    @F.pandas_udf("f1 long, f2 long, n_bytes long")
    def of(texts: pd.Series) -> pd.DataFrame:
        tables = [(m, b, powers(m, b, chunk)) for m, b in moduli]
        rows = []
        for text in texts:
            data = None if text is None else text.encode("utf-8", "surrogatepass")
            rows.append((None,) * 3 if data is None else (*fingerprint(data, tables, chunk), len(data)))
        return pd.DataFrame(rows, columns=KEY, dtype="Int64")

    return of


def sha_of(text: str) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def chunks_of(text: str, chunk: int) -> Column:
    """The UTF-8 bytes of a text in chunks; an empty text has one empty chunk."""
    data = F.encode(text, "UTF-8")
    last = F.greatest(F.ceil(F.octet_length(text) / chunk).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * chunk + 1, F.lit(chunk)))


def long_fingerprints(texts: DataFrame, moduli=MODULI, chunk: int = CHUNK_BYTES) -> DataFrame:
    """``f1, f2, n_bytes`` of the texts ``_norm`` by ``text_sha256``, their chunks hashed in parallel.

    Chunk rows are dealt out by place and row, so copies of one text are many
    tasks; they become one row a place before their hashes are combined.
    """

    @F.pandas_udf("h1 long, s1 long, h2 long, s2 long, n long")
    def hashes(chunks: pd.Series) -> pd.DataFrame:
        tables = [(m, b, powers(m, b, chunk)) for m, b in moduli]
        rows = []
        for data in chunks:
            own = fingerprint(data, tables, chunk)
            shifts = [pow(b, len(data), m) for m, b, _ in tables]
            rows.append((own[0], shifts[0], own[1], shifts[1], len(data)))
        return pd.DataFrame(rows, columns=["h1", "s1", "h2", "s2", "n"])

    parts = texts.select("_key", sha_of("_norm").alias("text_sha256"), F.posexplode(chunks_of("_norm", chunk)).alias("no", "data"))
    hashed = parts.repartition("text_sha256", "no", "_key").select("text_sha256", "no", hashes("data").alias("h"))
    single = hashed.groupBy("text_sha256", "no").agg(F.min("h").alias("h"))
    in_order = single.groupBy("text_sha256").agg(F.array_sort(F.collect_list(F.struct("no", "h"))).alias("hs"), F.sum("h.n").alias("n_bytes"))

    def combined(number: int) -> Column:
        modulus = F.lit(moduli[number - 1][0])
        return F.aggregate("hs", F.lit(0).cast("long"), lambda total, x: (total * x["h"][f"s{number}"] + x["h"][f"h{number}"]) % modulus)

    return in_order.select("text_sha256", combined(1).alias("f1"), combined(2).alias("f2"), "n_bytes")


def collisions(source: DataFrame, rows: DataFrame, chunk: int) -> DataFrame:
    """Fingerprints that differing texts share: chunkwise comparison of all equal ones.

    Only texts whose fingerprint occurs more than once in ``rows`` are moved.
    """
    again = durable(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*KEY))
    texts = durable(rows.join(sized(again), KEY, "left_semi").select(F.unhex("text_sha256").alias("_sha"), *KEY).distinct())
    few = source.select("_norm", F.unhex(sha_of("_norm")).alias("_sha")).join(sized(texts), "_sha")
    parts = few.select(*KEY, F.posexplode(chunks_of("_norm", chunk)).alias("chunk_no", "chunk"))
    places = parts.groupBy(*KEY, "chunk_no").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    return places.where(F.col("low") != F.col("high")).select(*KEY).distinct()


def exact_groups(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    normalise=lower_ascii,
    moduli=MODULI,
    chunk: int = CHUNK_BYTES,
    long_bytes: int = LONG_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Null texts count as empty, and empty texts are equal. Of equal texts the
    row with the largest key stays; a null key only where all are null. Of rows
    that repeat key and text one stays. No rows give no rows; other columns
    are not read, so their names don't matter.
    """
    source = docs.select(F.col(key).alias("_key"), normalise(F.col(text)).alias("_norm"))
    is_long = F.octet_length("_norm") >= long_bytes
    marked = source.select("_key", fingerprints(moduli, chunk)(F.when(~is_long, F.col("_norm"))).alias("_f"), sha_of("_norm").alias("text_sha256"))
    rows = durable(marked.select("_key", *[F.col(f"_f.{name}").alias(name) for name in KEY], "text_sha256"))
    unknown = F.col("n_bytes").isNull()
    if not rows.where(unknown).isEmpty():
        hashed = durable(long_fingerprints(source.where(is_long), moduli, chunk))
        of_long = rows.where(unknown).drop(*KEY).join(sized(hashed), "text_sha256")
        rows = durable(rows.where(~unknown).unionByName(of_long))
    clash = durable(collisions(source, rows, chunk))
    if clash.isEmpty():
        rows = rows.withColumn("_tie", F.lit(""))
    else:
        flagged = rows.join(clash.withColumn("_clash", F.lit(True)), KEY, "left")
        rows = flagged.withColumn("_tie", F.when(F.col("_clash"), F.col("text_sha256")).otherwise("")).drop("_clash")
    group = [*KEY, "_tie"]
    groups = rows.groupBy(*group).agg(F.max("_key").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # copies of a row become one row and a count before the join
    counted = rows.groupBy(*group, "_key", "text_sha256").agg(F.count(F.lit(1)).alias("_copies"))
    joined = counted.join(groups, group)
    single = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return single.select(
        F.col("_key").alias(key),
        "keep_id",
        "group_size",
        (F.col("_key").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", normalise=lower_ascii) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = durable(exact_groups(docs, key, text, normalise))
    stays = rows.where("kept").select(F.col(key).alias("_k"), F.col("text_sha256").alias("_s"))
    sha: Column = F.sha2(F.encode(normalise(F.col(text)), "UTF-8"), 256)
    known = docs.withColumn("_sha", sha)
    match = (F.col("_sha") == F.col("_s")) & F.col(key).eqNullSafe(F.col("_k"))
    kept = known.join(sized(stays), match, "left_semi")
    if not rows.where(~F.col("kept") & F.col(key).eqNullSafe(F.col("keep_id"))).isEmpty():
        # only where key and text repeat are the rows themselves compared
        kept = kept.dropDuplicates([key, "_sha"])
    return kept.select(*docs.columns)


@query(
    "op5_exact_dedup",
    """
    WITH n AS (
        SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
        FROM documents
    ), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(n.t) AS text_sha256
    FROM n JOIN g ON n.t = g.t
    """,
)
def op5_exact_dedup(spark, sf_dir):
    return exact_groups(read(spark, sf_dir, "documents"))
