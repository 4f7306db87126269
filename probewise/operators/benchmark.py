"""Search benchmark over gallery sizes: size by method by parameter.

Smaller galleries are samples of the larger ones by a hash of the id. Rows are
tagged with the smallest sample they are in, a search gives the best rows of
every tag, and the result for a size is the best of its tags. So a method
searches the gallery once, whatever the number of sizes.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probewise.operators.approximate import CellIndex, CellSearch, probed_lists
from probewise.operators.retrieval import OVERLAP_KS, latency_summary, topk_overlap
from probewise.operators.similarity import usable_rows, usual_width
from probewise.operators.vector_tables import index_bytes
from probewise.session import durable

SHARES = (0.25, 0.5, 1.0)


@dataclass
class Method:
    """A search to be measured: ``kind`` and ``params`` as in ``index_bytes``; without ``search`` it has failed with ``error``."""

    name: str
    kind: str
    search: CellSearch | None
    nprobe: int = 1
    params: Mapping[str, int] = field(default_factory=dict)
    error: str = ""
    notes: str = ""


def flat_method(gallery: DataFrame) -> Method:
    """Exact search, as one cell."""
    width = usual_width(gallery)
    rows = usable_rows(gallery, width).select("id", "v", F.lit(0).alias("cell"))
    return Method("flat", "flat", CellSearch(CellIndex(np.zeros((1, width)), durable(rows))))


def attempt(name: str, kind: str, build, nprobe: int, params: Mapping[str, int] | None = None, notes: str = "") -> Method:
    """The method that ``build()`` searches by; one that cannot be built stays with its error."""
    try:
        return Method(name, kind, build(), nprobe, params or {}, notes=notes)
    except ValueError as problem:
        return Method(name, kind, None, nprobe, params or {}, str(problem), notes)


def tag_of(key: str, shares: Sequence[float]) -> Column:
    """Number of the smallest share that the row of this id is in; as many as there are shares if in none."""
    place = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    tag = F.lit(len(shares))
    for number in reversed(range(len(shares))):
        tag = F.when(place < int(shares[number] * (1 << 32)), number).otherwise(tag)
    return tag.cast("int")


def sized_search(method: Method, probes: DataFrame, k: int, shares: Sequence[float]) -> DataFrame:
    """``(share, probe_id, id, score, rank)``: the top-k of every size, from one search."""
    tags = len(shares) + 1
    local = method.search.scores(probes, k, 0, method.nprobe, tags, tag_of("id", shares))
    # the sizes of a probe are ranked where its rows are
    tagged = local.where(F.col("tag") < len(shares)).repartition("probe_id")
    listed = F.array(*[F.lit(float(s)) for s in shares])
    sized = tagged.withColumn("share", F.explode(F.slice(listed, F.col("tag") + 1, len(shares))))
    window = Window.partitionBy("share", "probe_id").orderBy(F.desc("score"), "id")
    return (
        sized.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).select("share", "probe_id", "id", "score", "rank")
    )


def scanned_rows(method: Method, probes: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``(share, probe_id, scanned)``: how many rows of each size a probe is compared with."""
    per_share = [F.count_if(tag_of("id", shares) <= number).alias(f"n{number}") for number in range(len(shares))]
    counts = method.search.rows.groupBy("cell").agg(*per_share)
    # the lists of cells are read by every pass over the result
    listed = durable(probed_lists(probes, method.search.index, method.nprobe).select("probe_id", "inner"))
    cells = listed.select("probe_id", F.explode("inner").alias("cell"))
    sums = [F.coalesce(F.sum(f"n{number}"), F.lit(0)).alias(f"n{number}") for number in range(len(shares))]
    totals = cells.join(counts, "cell", "left").groupBy("probe_id").agg(*sums)
    rows = F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"n{number}").alias("scanned")) for number, s in enumerate(shares)])
    return totals.select("probe_id", F.inline(rows)).select("share", "probe_id", "scanned")


def benchmark_sizes(
    probes: DataFrame,
    gallery: DataFrame,
    methods: Sequence[Method],
    shares: Sequence[float] = SHARES,
    ks: Sequence[int] = OVERLAP_KS,
) -> tuple[DataFrame, dict[str, float]]:
    """One row per size and method, and the seconds of each method's search over all sizes.

    ``(share, vectors, method, nprobe, status, error, notes, memory_bytes, scanned_mean,
    scanned_p50, scanned_p95, scanned_p99, overlap_at_...)``: overlap with exact
    search of the same size, estimated bytes of the index, and the summary of the rows
    a query is compared with, which unlike a batch's time is a cost per query.
    Methods that failed have rows with their error.
    """
    spark, k = probes.sparkSession, max(ks)
    width = usual_width(gallery)
    rows = usable_rows(gallery, width)
    sizes = rows.agg(*[F.count_if(tag_of("id", shares) <= number).alias(f"n{number}") for number in range(len(shares))]).first()
    exact = durable(sized_search(flat_method(gallery), probes, k, shares))
    seconds, found, scanned = {}, None, None
    for method in methods:
        if method.search is None:
            continue
        started = time.perf_counter()
        result = durable(sized_search(method, probes, k, shares)).withColumn("method", F.lit(method.name))
        seconds[method.name] = time.perf_counter() - started
        work = scanned_rows(method, probes, shares).withColumn("method", F.lit(method.name))
        found = result if found is None else found.unionByName(result)
        scanned = work if scanned is None else scanned.unionByName(work)

    table = [
        (float(share), int(n), m.name, m.nprobe, "ok" if m.search else "failed", m.error, m.notes, m.kind, width)
        for share, n in zip(shares, sizes)
        for m in methods
    ]
    base = spark.createDataFrame(
        table, "share double, vectors long, method string, nprobe int, status string, error string, notes string, kind string, dim long"
    )
    memory = F.lit(None).cast("long")
    for m in methods:
        if m.search is not None:
            bytes_of = index_bytes(m.kind, F.col("vectors"), F.col("dim"), m.params)
            memory = F.when(F.col("method") == m.name, bytes_of).otherwise(memory)
    base = base.withColumn("memory_bytes", memory).drop("kind", "dim")
    names = ["scanned_mean", "scanned_p50", "scanned_p95", "scanned_p99", *[f"overlap_at_{k}" for k in ks]]
    if found is None:
        return base.withColumns({name: F.lit(None).cast("double") for name in names}), seconds
    work = latency_summary(scanned.withColumn("scanned", F.col("scanned").cast("double")), "scanned", ["share", "method"])
    work = work.select("share", "method", *[F.col(c).alias(f"scanned_{c}") for c in ("mean", "p50", "p95", "p99")])
    built = F.array(*[F.lit(name) for name in seconds])
    overlap = topk_overlap(exact.withColumn("method", F.explode(built)), found, ks, ["share", "method"])
    overlap = overlap.groupBy("share", "method").agg(*[F.max(F.when(F.col("k") == k, F.col("overlap"))).alias(f"overlap_at_{k}") for k in ks])
    return base.join(work, ["share", "method"], "left").join(overlap, ["share", "method"], "left"), seconds
