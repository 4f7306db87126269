"""Similarity joins: exact top-k, re-scoring, hydration, pair scoring.

Probes are ``(probe_id, v)``, a gallery is ``(id, v)``; vectors are float or
double arrays of one length and are made unit vectors where they are scored.
Scores are inner products rounded to six digits, ties go to the smaller id; a
zero vector scores 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from probewise.functions.labels import is_scale_label
from probewise.functions.vectors import cosine, is_usable
from probewise.session import durable

SCORE_DIGITS = 6
# a side held by every task: at most this many bytes of float64
BROADCAST_BYTES = 64 << 20
# rows of one block of a blocked search at least, and probes scored in one product
BLOCK_ROWS = 16_384
PROBE_CHUNK = 512
# vectors scored in one product, and those of one product with held probes: its scores stay in a core's cache
SLICE_ROWS, HELD_SLICE = 4096, 1024
# float64 bytes of the vectors of a block, if these are small enough to be more than was asked for: larger blocks are shipped less often
SHIP_BYTES = 16 << 20
# blocks of a cell's probes at least, for tasks to share the work of one cell
PROBE_BLOCKS = 8
# best places that a task gathers for some probes of a block before it goes on with the next ones, about
PLACES = 250_000
# gallery rows of a page at most, bytes of the pages that pass through one task, about
PAGE_ROWS, STREAM_BYTES = 2048, 256 << 20
# float64 bytes and best places of the probes that a task holds, about: the gallery is shipped once for all of them
HELD_BYTES, HELD_PLACES = 32 << 20, 2_000_000
# products that make a task worth its start; passing a row on takes as long as so many of them
TASK_PRODUCTS, ROW_PRODUCTS = 200_000_000, 4000
# routing vectors of a bounded search at most, and what bounds may be off by: rounding to six digits and angles
ROUTES, BOUND_SLACK = 1024, 2e-6
# share of the cells from which on a probe that asks for some of them is shipped once to the tasks that see all cells
SPARSE = 1 / 8
# rounding error of one single-precision operation
SINGLE_ERROR = 2.0**-24


def as_probes(df: DataFrame, vec: str, key: str) -> DataFrame:
    """``(probe_id, v)`` of the rows that have a vector."""
    return df.select(F.col(key).alias("probe_id"), F.col(vec).alias("v")).where("v IS NOT NULL")


def as_gallery(df: DataFrame, vec: str, key: str) -> DataFrame:
    """``(id, v)`` of the rows that have a vector."""
    return df.select(F.col(key).alias("id"), F.col(vec).alias("v")).where("v IS NOT NULL")


def vector_width(df: DataFrame, vec: str = "v") -> int:
    """Dimension of the first vector, 0 for an empty table."""
    row = df.select(F.size(vec)).first()
    return int(row[0]) if row else 0


def usable_rows(df: DataFrame, width: int) -> DataFrame:
    """Rows whose vector has ``width`` elements, all finite; zero vectors score 0 and stay."""
    v = F.col("v")
    return df.where(F.col("v").isNotNull() & (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def usable_sides(probes: DataFrame, gallery: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides without the vectors that can't be compared; the gallery's usual width is the one that counts."""
    width = usual_width(gallery)
    return usable_rows(probes, width), usable_rows(gallery, width)


def left_out(df: DataFrame, width: int) -> DataFrame:
    """``rows, missing, other_width, not_finite`` of a table: what a search over it leaves out."""
    v, sized = F.col("v"), F.size("v") == width
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(v.isNull()).alias("missing"),
        F.count_if(v.isNotNull() & ~sized).alias("other_width"),
        F.count_if(v.isNotNull() & sized & ~finite).alias("not_finite"),
    )


def usual_width(df: DataFrame, vec: str = "v") -> int:
    """The most frequent dimension, the larger one on ties; 0 for an empty table."""
    row = df.where(F.col(vec).isNotNull()).groupBy(F.size(vec).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return int(row[0]) if row else 0


def as_matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """List column as a matrix. Rows must have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def unit_matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """List column as a matrix of unit rows; zero rows stay zero."""
    return unit_rows(as_matrix(column).astype(np.float64, copy=False))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(lengths > 0, lengths, 1.0)


def score_order(row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The order by row, falling rounded score and id."""
    whole = np.rint(scores * 10**SCORE_DIGITS)
    if not len(row) or row.max() >= 1 << 21 or np.abs(whole).max() >= 1 << 40:
        return np.lexsort((ids, -scores, row))
    # row and score in one number, sorted at once; only ties need the ids
    both = (row.astype(np.int64) << 42) - whole.astype(np.int64)
    order = np.argsort(both)
    both = both[order]
    same = both[1:] == both[:-1]
    if same.any():
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        order[tied] = order[tied][np.lexsort((ids[order[tied]], both[tied]))]
    return order


def first_k(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best entries of every row, best first; ties by id. Scores are rounded."""
    order = score_order(row, ids, scores)
    row = row[order]
    return order[np.arange(len(row)) - np.searchsorted(row, row) < k]


def near_rows(rough: np.ndarray, floor: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of all rough scores that can be among the ``k`` best of a row.

    ``floor`` is what the ``k``-th best of a row is known to reach, ``slack`` what
    a rough score may be off by; few scores reach a good floor, so only without
    one the ``k``-th best has to be looked for.
    """
    count = rough.shape[1]
    reach = rough >= (floor - slack).astype(np.float32)[:, None]
    if count > k and np.count_nonzero(reach) > 8 * k * len(rough):
        crowded = np.flatnonzero(np.count_nonzero(reach, axis=1) > 8 * k)
        own = np.partition(rough[crowded], count - k, axis=1)[:, count - k]
        reach[crowded] &= rough[crowded] >= (own - np.float32(2 * slack))[:, None]
    flat = reach.ravel()
    if flat.size % 8:
        return np.divmod(np.flatnonzero(flat), count)
    # few are set, so eight are looked at together
    words = np.flatnonzero(flat.view(np.uint64))
    return np.divmod((words[:, None] * 8 + np.arange(8))[flat.reshape(-1, 8)[words]], count)


def best_of_slices(
    ids: np.ndarray,
    k: int,
    floor: np.ndarray,
    slack: float,
    rough: Callable[[slice], np.ndarray],
    exact: Callable[[np.ndarray, np.ndarray], np.ndarray],
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best columns of every row: (row, column, score rounded to six digits).

    ``rough(columns)`` gives all scores of a slice in single precision, off by
    ``slack`` at most with the rounding; the few that can count are scored by ``exact(row, column)``.
    """
    row, col, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    floor = floor.copy()
    for low in range(0, len(ids), SLICE_ROWS):
        more, at = near_rows(rough(slice(low, low + SLICE_ROWS)), floor, k, slack)
        if not len(more):
            continue
        at = at + low
        found = [exact(more[i : i + BLOCK_ROWS], at[i : i + BLOCK_ROWS]) for i in range(0, len(more), BLOCK_ROWS)]
        row, col = np.concatenate([row, more]), np.concatenate([col, at])
        score = np.concatenate([score, np.round(np.concatenate(found), SCORE_DIGITS) + 0.0])
        best = first_k(row, ids[col], score, k)
        row, col, score = row[best], col[best], score[best]
        # rows are in order, so the last of k entries is the k-th best
        last = np.flatnonzero(row[k - 1 :] == row[: max(0, len(row) - k + 1)]) + k - 1
        floor[row[last]] = np.maximum(floor[row[last]], score[last])
    return row, col, score


def score_block(
    probe_ids: np.ndarray, probes: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top-k of every unit probe against a set of unit vectors: (probe ids, ids, scores).

    Probes and vectors are taken in slices, so the score matrix stays small. The
    product is done in single precision; the few pairs within its error of the
    k-th best are scored again in double precision, so none is missed. Scores
    below a probe's ``floor`` may be left out.
    """
    parts, single = [], vectors.astype(np.float32)
    slack = 2 * (vectors.shape[1] + 2) * SINGLE_ERROR + 10.0**-SCORE_DIGITS
    floor = np.full(len(probes), -np.inf) if floor is None else floor
    for start in range(0, len(probe_ids), PROBE_CHUNK):
        chunk = probes[start : start + PROBE_CHUNK]
        rough = chunk.astype(np.float32)
        row, col, score = best_of_slices(
            ids,
            k,
            floor[start : start + PROBE_CHUNK],
            slack,
            lambda columns: rough @ single[columns].T,
            lambda r, c: np.einsum("ij,ij->i", chunk[r], vectors[c]),
        )
        parts.append((probe_ids[start + row], ids[col], score))
    return tuple(np.concatenate(column) for column in zip(*parts))


def result_schema(probes: DataFrame, gallery: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("probe_id", probes.schema["probe_id"].dataType),
            T.StructField("id", gallery.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def as_table(schema: T.StructType, columns: tuple) -> pa.Table:
    arrays = [pa.array(c, type=to_arrow_type(f.dataType)) for c, f in zip(columns, schema)]
    return pa.table(arrays, names=schema.names)


def keep_best(scored: DataFrame, k: int, together: bool = False) -> DataFrame:
    """Merge local results into ``(probe_id, id, score, distance, rank)``.

    A probe id has ``k`` rows in all, whatever the path and however often the id
    occurs; a gallery id counts with its best score. Rows of few repeats are
    shipped once if those of a probe are put ``together`` first.
    """
    if together:
        scored = scored.repartition("probe_id")
    scored = scored.groupBy("probe_id", "id").agg(F.max("score").alias("score"))
    window = Window.partitionBy("probe_id").orderBy(F.col("score").desc(), F.col("id").asc())
    return (
        scored.withColumn("rank", F.row_number().over(window))
        .where(F.col("rank") <= k)
        .select("probe_id", "id", "score", F.round(1 - F.col("score"), SCORE_DIGITS).alias("distance"), "rank")
    )


def hold(df: DataFrame, key: str) -> Broadcast:
    """Ids and unit vectors of a table of checked size, for every task."""
    table = df.select(key, "v").toArrow()
    return df.sparkSession.sparkContext.broadcast((table[key].to_numpy(), unit_matrix(table["v"])))


def scan_gallery(probes: DataFrame, gallery: DataFrame, k: int) -> DataFrame:
    """Top-k with all probes held by every task; only for few probes.

    The gallery is read once and not shuffled, only local top-k rows are.
    """
    schema = result_schema(probes, gallery)
    held = hold(probes, "probe_id")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe_ids, matrix = held.value
        rows, best = np.arange(len(probe_ids)), None
        for batch in batches:
            if batch.num_rows and len(probe_ids):
                ids = batch.column("id").to_numpy(zero_copy_only=False)
                found = score_block(rows, matrix, ids, unit_matrix(batch.column("v")), k)
                if best is not None:
                    found = tuple(np.concatenate(pair) for pair in zip(best, found))
                # a task sends the best of all its batches, once
                kept = first_k(*found, k)
                best = tuple(column[kept] for column in found)
        if best is not None:
            yield from as_table(schema, (probe_ids[best[0]], *best[1:])).to_batches()

    return keep_best(gallery.select("id", "v").mapInArrow(scan, schema), k)


def scan_probes(probes: DataFrame, gallery: DataFrame, k: int) -> DataFrame:
    """Top-k with the whole gallery held by every task; only for a small one.

    Every probe is scored where it is read; only its best rows are shuffled.
    """
    schema = result_schema(probes, gallery)
    held = hold(gallery, "id")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = held.value
        for batch in batches:
            if batch.num_rows and len(ids):
                keys = batch.column("probe_id").to_numpy(zero_copy_only=False)
                # row numbers stand for the probes, so equal ids stay apart
                rows, found, scores = score_block(np.arange(len(keys)), unit_matrix(batch.column("v")), ids, matrix, k)
                yield from as_table(schema, (keys[rows], found, scores)).to_batches()

    return keep_best(probes.select("probe_id", "v").mapInArrow(scan, schema), k)


def cell_plan(probes: DataFrame, gallery: DataFrame, block_rows: int, width: int) -> DataFrame:
    """``(cell, psubs, gsubs)``: into how many blocks each cell's two sides are split.

    A cell is never one group: however many rows it holds, a block of it has as
    many as ``shipped_rows`` tells, and its probes are ``PROBE_BLOCKS`` blocks
    if they fill as many of ``block_rows``.
    """
    rows, most = F.count(F.lit(1)), shipped_rows(block_rows, width)
    psubs = F.greatest(F.ceil(rows / most), F.least(F.ceil(rows / block_rows), F.lit(PROBE_BLOCKS)))
    asked = probes.groupBy("cell").agg(psubs.cast("int").alias("psubs"))
    held = gallery.groupBy("cell").agg(F.ceil(rows / most).cast("int").alias("gsubs"))
    # one row per cell, and the centroids of all cells fit into a task
    return F.broadcast(asked.join(held, "cell"))


def shipped_rows(block_rows: int, width: int) -> int:
    """Rows of a block: ``block_rows``, or more if ``SHIP_BYTES`` hold more vectors.

    Every block is sent to all of the other side, so what two sides ship is the
    product of their rows by the rows of a block.
    """
    return max(block_rows, SHIP_BYTES // (8 * max(width, 1)))


def blocked_scores(
    probes: DataFrame,
    gallery: DataFrame,
    k: int,
    block_rows: int,
    width: int,
    score_pair: Callable[[pa.Table, pa.Table], tuple] | None = None,
) -> DataFrame:
    """Local top-k per pair of blocks. Both sides carry a ``cell`` column, vectors have ``width`` elements.

    A probe meets every block of its cells, a gallery block meets every probe
    block of its cell, and one pair of blocks is scored by the vectors ``v``,
    slice by slice, or is what ``score_pair`` makes of the two tables.
    """
    schema = result_schema(probes, gallery)
    plan = cell_plan(probes, gallery, block_rows, width)
    keys = ["cell", "psub", "gsub"]

    def block_of(key: str, blocks: str):
        return F.pmod(F.xxhash64(key), F.col(blocks)).cast("int")

    def copies(blocks: str):
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    left = (
        probes.join(plan, "cell")
        .withColumn("psub", block_of("probe_id", "psubs"))
        .withColumn("gsub", copies("gsubs"))
        .select(*keys, *[name for name in probes.columns if name != "cell"])
    )
    right = (
        gallery.join(plan, "cell")
        .withColumn("gsub", block_of("id", "gsubs"))
        .withColumn("psub", copies("psubs"))
        .select(*keys, *[name for name in gallery.columns if name != "cell"])
    )

    def score(left_block: pa.Table, right_block: pa.Table) -> pa.Table:
        if not len(left_block) or not len(right_block):
            return as_table(schema, ([], [], []))
        if score_pair is not None:
            return as_table(schema, score_pair(left_block, right_block))
        found = score_block(
            left_block["probe_id"].to_numpy(),
            unit_matrix(left_block["v"]),
            right_block["id"].to_numpy(),
            unit_matrix(right_block["v"]),
            k,
        )
        return as_table(schema, found)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, schema)


def pages_of(gallery: DataFrame) -> DataFrame:
    """``(cell, inner, tag, ids, data)``: rows of one cell and tag together, their vectors or codes as bytes.

    A page is passed on as one row, so rows that go to many tasks cost their bytes and little more.
    """
    values = "codes" if "codes" in gallery.columns else "v"
    single = values == "v" and isinstance(gallery.schema["v"].dataType.elementType, T.FloatType)
    listed = T.StructType([T.StructField("ids", T.ArrayType(gallery.schema["id"].dataType)), T.StructField("data", T.BinaryType())])
    schema = T.StructType([*T.StructType.fromDDL("cell int, inner int, tag int").fields, *listed])

    def cut(table: pa.Table) -> pa.RecordBatch:
        keys = [table[name].to_numpy() for name in ("cell", "inner", "tag")]
        order = np.lexsort(keys[::-1])
        keys = [key[order] for key in keys]
        changes = np.any([key[1:] != key[:-1] for key in keys], axis=0)
        starts = np.append(np.flatnonzero(np.append(True, changes)), len(order))
        starts = np.concatenate([np.arange(a, b, PAGE_ROWS) for a, b in zip(starts, starts[1:])])
        ends = np.append(starts[1:], len(order))
        ids = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)).astype(np.int32)), table["id"].combine_chunks().take(pa.array(order)))
        if values == "codes":
            codes = table["codes"].to_pylist()
            data = [b"".join(codes[i] for i in order[a:b]) for a, b in zip(starts, ends)]
        else:
            matrix = as_matrix(table["v"]).astype(np.float32 if single else np.float64, copy=False)[order]
            data = [matrix[a:b].tobytes() for a, b in zip(starts, ends)]
        return pa.RecordBatch.from_arrays([*[pa.array(key[starts].astype(np.int32)) for key in keys], ids, pa.array(data, pa.binary())], names=schema.names)

    def page(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, count = [], 0
        for batch in batches:
            waiting.append(batch)
            count += batch.num_rows
            if count >= 16 * PAGE_ROWS:
                yield cut(pa.Table.from_batches(waiting))
                waiting, count = [], 0
        if count:
            yield cut(pa.Table.from_batches(waiting))

    return gallery.select("id", values, "cell", "inner", "tag").mapInArrow(page, schema)


class VectorRows:
    """Gallery rows as unit vectors."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors, self.single = vectors, vectors.astype(np.float32)

    def slack(self, base: np.ndarray) -> float:
        """What a rough score may be off by, with the rounding."""
        return 2 * (self.vectors.shape[1] + 2) * SINGLE_ERROR + 10.0**-SCORE_DIGITS

    def rough(self, probes: np.ndarray, base: np.ndarray, columns: slice) -> np.ndarray:
        return probes.astype(np.float32) @ self.single[columns].T

    def exact(self, probes: np.ndarray, base: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", probes[row], self.vectors[col])


class HeldProbes:
    """The best rows so far of the probes that a task holds, while gallery rows pass.

    With ``once`` an id takes one place, else it takes one wherever it occurs. Rows of a
    ``tag`` may be left out if the tags up to it have ``k`` better ones.
    """

    def __init__(self, table: pa.Table, k: int, tags: int, once: bool) -> None:
        vectors = as_matrix(table["v"]).astype(np.float64, copy=False)
        lengths = np.linalg.norm(vectors, axis=1)
        lengths[lengths == 0] = 1.0
        self.ids, self.vectors, self.k, self.once = table["probe_id"].to_numpy(), vectors / lengths[:, None], k, once
        inner = table["inner"].combine_chunks()
        rows = np.repeat(np.arange(len(table)), inner.value_lengths().to_numpy())
        cells = inner.flatten().to_numpy()
        order = np.argsort(cells, kind="stable")
        self.cells, self.rows = cells[order], rows[order]
        self.base = table["base"].combine_chunks().flatten().to_numpy(zero_copy_only=False)[order] / lengths[self.rows]
        floor = np.nan_to_num(table["floor"].to_numpy().astype(np.float64), nan=-np.inf)
        self.floor = np.repeat(floor[None, :], tags, axis=0)
        self.best = [(np.empty(0, np.int64), None, np.empty(0))] * tags
        self.more: list[list[tuple]] = [[] for _ in range(tags)]
        self.near = (None, None, None, None)

    def asking(self, cell: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the probes that ask for a cell, their vectors and their products with its centroid."""
        if self.near[0] != cell:
            low, high = np.searchsorted(self.cells, [cell, cell + 1])
            rows = self.rows[low:high]
            every = len(rows) == len(self.vectors) and (rows == np.arange(len(rows))).all()
            self.near = (cell, rows, self.vectors if every else self.vectors[rows], self.base[low:high])
        return self.near[1:]

    def meet(self, cell: int, tag: int, ids: np.ndarray, of: VectorRows) -> None:
        """Score rows of one cell and tag, slice by slice."""
        rows, vectors, base = self.asking(cell)
        if not len(rows):
            return
        slack = of.slack(base)
        k = self.k * int(np.unique(ids, return_counts=True)[1].max()) if self.once else self.k
        for low in range(0, len(ids), HELD_SLICE):
            columns = slice(low, low + HELD_SLICE)
            for start in range(0, len(rows), PROBE_CHUNK):
                part = slice(start, start + PROBE_CHUNK)
                floor = self.floor[tag][rows[part]]
                row, col = near_rows(of.rough(vectors[part], base[part], columns), floor, k, slack)
                found = [
                    of.exact(vectors[part], base[part], row[i : i + BLOCK_ROWS], col[i : i + BLOCK_ROWS] + low) for i in range(0, len(row), BLOCK_ROWS)
                ]
                if not found:
                    continue
                score = np.round(np.concatenate(found), SCORE_DIGITS) + 0.0
                kept = np.flatnonzero(score >= floor[row])
                if len(kept) > 2 * k * len(floor):
                    # equal scores can be many
                    kept = kept[first_k(row[kept], ids[col[kept] + low], score[kept], k)]
                self.more[tag].append((rows[part][row[kept]], ids[col[kept] + low], score[kept]))
            if sum(len(part[0]) for part in self.more[tag]) > len(self.best[tag][0]) // 2:
                self.settle(tag)

    def settle(self, tag: int) -> None:
        parts = [part for part in (self.best[tag], *self.more[tag]) if len(part[0])]
        self.more[tag] = []
        if not parts:
            return
        row, ids, score = (np.concatenate(column) for column in zip(*parts))
        if self.once:
            order = np.lexsort((-score, ids, row))
            row, ids, score = row[order], ids[order], score[order]
            kept = np.append(True, (row[1:] != row[:-1]) | (ids[1:] != ids[:-1]))
            row, ids, score = row[kept], ids[kept], score[kept]
        best = first_k(row, ids, score, self.k)
        row, ids, score = row[best], ids[best], score[best]
        self.best[tag] = (row, ids, score)
        # rows are in order, so the last of k entries is the k-th best
        last = np.flatnonzero(row[self.k - 1 :] == row[: max(0, len(row) - self.k + 1)]) + self.k - 1
        for own in self.floor[tag:]:
            own[row[last]] = np.maximum(own[row[last]], score[last])

    def result(self) -> Iterator[tuple]:
        for tag in range(len(self.best)):
            self.settle(tag)
            row, ids, score = self.best[tag]
            for low in range(0, len(row), PLACES):
                part = slice(low, low + PLACES)
                yield self.ids[row[part]], ids[part], score[part], np.full(len(row[part]), tag, np.int32)


class HeldCandidates(HeldProbes):
    """Held probes that are compared with the rows in their lists ``wanted`` only."""

    def __init__(self, table: pa.Table, k: int, tags: int, once: bool) -> None:
        super().__init__(table, k, tags, once)
        wanted = table["wanted"].combine_chunks()
        ids = wanted.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        self.wanted, self.by = ids[order], np.repeat(np.arange(len(table)), wanted.value_lengths().to_numpy())[order]

    def meet(self, cell: int, tag: int, ids: np.ndarray, of: VectorRows) -> None:
        low, high = np.searchsorted(self.wanted, ids, "left"), np.searchsorted(self.wanted, ids, "right")
        count = high - low
        col = np.repeat(np.arange(len(ids)), count)
        row = self.by[np.arange(len(col)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
        for i in range(0, len(row), BLOCK_ROWS):
            r, c = row[i : i + BLOCK_ROWS], col[i : i + BLOCK_ROWS]
            score = np.round(of.exact(self.vectors, self.base, r, c), SCORE_DIGITS) + 0.0
            self.more[tag].append((r, ids[c], score))
        if sum(len(part[0]) for part in self.more[tag]) > max(PLACES, len(self.best[tag][0])):
            self.settle(tag)


@dataclass
class TaskPlan:
    """Which tasks hold the probes of a cell and which of its gallery rows pass there."""

    cells: list[tuple[int, int, int, list[int], list[int]]]
    partitions: int

    def table(self, spark: SparkSession) -> DataFrame:
        whole, many = pa.int32(), pa.list_(pa.int32())
        fields = [("cell", whole), ("psubs", whole), ("gsubs", whole), ("numbers", many), ("parts", many)]
        columns = zip(*self.cells) if self.cells else [()] * len(fields)
        return F.broadcast(spark.createDataFrame(pa.table({name: pa.array(list(x), kind) for (name, kind), x in zip(fields, columns)})))


def plan_tasks(
    asked: dict[int, int], held: dict[int, int], hold: int, most: int, block_rows: int, row_bytes: int, parallelism: int
) -> TaskPlan:
    """Deal cells with ``asked`` probes and ``held`` gallery rows to tasks, and small tasks to one partition.

    A task holds about ``hold`` probes. The rows of a cell are one stream, or several
    if they have more than ``STREAM_BYTES``, or ``most`` rows while tasks are too few to be shared.
    """
    sizes = [(cell, asked[cell], held[cell]) for cell in sorted(asked.keys() & held.keys())]
    psubs = [max(-(-p // hold), min(-(-p // block_rows), PROBE_BLOCKS)) for _, p, _ in sizes]
    share = -(-2 * parallelism // max(1, sum(psubs)))
    gsubs = [max(-(-g * row_bytes // STREAM_BYTES), min(share, -(-g // most))) for _, _, g in sizes]
    work = [p * g // (n * m) + ROW_PRODUCTS * (p // n + g // m) for (_, p, g), n, m in zip(sizes, psubs, gsubs)]
    enough = max(TASK_PRODUCTS, sum(w * n * m for w, n, m in zip(work, psubs, gsubs)) // max(1, 8 * parallelism))
    cells, number, part, filled = [], 0, 0, 0
    for (cell, _, _), n, m, w in zip(sizes, psubs, gsubs, work):
        parts = []
        for _ in range(n * m):
            if filled and filled + w > enough:
                part, filled = part + 1, 0
            parts.append(part)
            filled += w
        cells.append((cell, n, m, list(range(number, number + n * m)), parts))
        number += n * m
    return TaskPlan(cells, part + 1)


def held_scores(
    probes: DataFrame,
    gallery: DataFrame,
    k: int,
    block_rows: int,
    width: int,
    rows_of: Callable[[np.ndarray], VectorRows] | None = None,
    tags: int = 1,
    once: bool = False,
    keep: type[HeldProbes] = HeldProbes,
) -> DataFrame:
    """``(probe_id, id, score, tag)``: local top-k of probes that are held while the gallery passes.

    Probes are ``(cell, probe_id, v, inner, base, floor)``, the gallery is ``(cell, inner, tag, id)``
    with vectors ``v`` or ``codes``. A probe meets the rows of its cell whose ``inner`` is in its
    list. A task holds a block of the probes of a cell and keeps their best rows, while all pages of
    the cell pass: what is shipped is the gallery once for each block of probes, and what comes
    out is ``k`` rows a probe and tag for each stream of pages, not for each pair of blocks.
    ``rows_of`` makes codes rows that can be scored.
    """
    spark, rows = probes.sparkSession, F.count(F.lit(1))
    coded = "codes" in gallery.columns
    single = not coded and isinstance(gallery.schema["v"].dataType.elementType, T.FloatType)
    most = shipped_rows(block_rows, width)
    hold = max(1, min(max(block_rows, HELD_BYTES // (8 * max(width, 1))), HELD_PLACES // (k * tags)))
    # one row per cell, and the centroids of all cells fit into the driver
    asked, held = (dict(map(tuple, df.groupBy("cell").agg(rows).collect())) for df in (probes, gallery))
    row_bytes = 8 + (width if coded else width * (4 if single else 8))
    plan = plan_tasks(asked, held, hold, most, block_rows, row_bytes, spark.sparkContext.defaultParallelism)
    told = plan.table(spark)
    schema = T.StructType([*result_schema(probes, gallery), T.StructField("tag", T.IntegerType())])

    def copies(blocks: str):
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    place = F.col("psub") * F.col("gsubs") + F.col("gsub")
    # probes come first, then the pages by their inner cells
    task = F.shiftleft(F.get("numbers", place).cast("long"), 32)
    left = (
        probes.join(told, "cell")
        .withColumn("psub", F.pmod(F.xxhash64("probe_id"), F.col("psubs")).cast("int"))
        .withColumn("gsub", copies("gsubs"))
        .select(F.get("parts", place).alias("_part"), task.alias("_at"), *[name for name in probes.columns if name != "cell"])
    )
    right = (
        pages_of(gallery)
        .join(told, "cell")
        .withColumn("gsub", F.pmod(F.xxhash64("ids"), F.col("gsubs")).cast("int"))
        .withColumn("psub", copies("psubs"))
        .select(F.get("parts", place).alias("_part"), (task + F.col("inner") + 1).alias("_at"), "tag", "ids", "data")
    )
    both = left.unionByName(right, allowMissingColumns=True).repartitionById(plan.partitions, "_part").sortWithinPartitions("_at")

    def meet(state: HeldProbes, run: pa.RecordBatch, cells: np.ndarray) -> None:
        tag, ids, data = run.column("tag").to_numpy(), run.column("ids"), run.column("data")
        sizes, order = ids.value_lengths().to_numpy(), np.lexsort((tag, cells))
        low = 0
        while low < len(order):
            # pages of one cell and tag, as many as are scored together
            cell, own, high, count = cells[order[low]], tag[order[low]], low, 0
            while high < len(order) and count < BLOCK_ROWS and (cells[order[high]], tag[order[high]]) == (cell, own):
                count += sizes[order[high]]
                high += 1
            some = order[low:high]
            low = high
            found = ids.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False)
            raw = b"".join(data[int(i)].as_py() for i in some)
            if coded:
                of = rows_of(np.frombuffer(raw, np.uint8).reshape(len(found), -1))
            else:
                of = VectorRows(unit_rows(np.frombuffer(raw, np.float32 if single else np.float64).reshape(len(found), -1).astype(np.float64)))
            state.meet(cell, own, found, of)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting, state = -1, [], None
        for batch in batches:
            at = batch.column("_at").to_numpy()
            key = np.where(at & 0xFFFFFFFF, at | 0xFFFFFFFF, at)
            for run in np.split(np.arange(len(at)), np.flatnonzero(key[1:] != key[:-1]) + 1):
                if not len(run):
                    continue
                part = batch.slice(run[0], len(run))
                if at[run[0]] >> 32 != number:
                    if state is not None:
                        for found in state.result():
                            yield from as_table(schema, found).to_batches()
                    number, waiting, state = at[run[0]] >> 32, [], None
                cells = (at[run] & 0xFFFFFFFF).astype(np.int64) - 1
                if cells[0] < 0:
                    waiting.append(part)
                    continue
                if state is None and waiting:
                    state, waiting = keep(pa.Table.from_batches(waiting), k, tags, once), []
                if state is not None:
                    meet(state, part, cells)
        if state is not None:
            for found in state.result():
                yield from as_table(schema, found).to_batches()

    return both.drop("_part").mapInArrow(stream, schema)


def topk_blocked(probes: DataFrame, gallery: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact top-k for any number of probes: blocks against blocks."""
    one, width = F.lit(0), usual_width(gallery)
    probes, gallery = usable_rows(probes, width), usable_rows(gallery, width)
    both = (probes.select("probe_id", "v", one.alias("cell")), gallery.select("id", "v", one.alias("cell")))
    local = blocked_scores(*both, k, block_rows, width)
    return keep_best(local, k)


@dataclass
class RoutedBlocks:
    """Gallery rows ``(id, v, cell)`` dealt to the nearest of some unit vectors.

    ``angle`` is the largest angle of a cell's rows to its routing vector. The
    last cell has the zero vectors, which score 0. Cells without rows count 0.
    """

    routes: np.ndarray
    angle: np.ndarray
    counts: np.ndarray
    rows: DataFrame

    def bundles(self, most: int) -> np.ndarray:
        """The number of each cell's bundle: cells that are shipped together, ``most`` rows of them or one larger cell."""
        numbers, number, size = np.zeros(len(self.counts), np.int32), 0, 0
        for cell, count in enumerate(self.counts):
            if size and size + count > most:
                number, size = number + 1, 0
            numbers[cell], size = number, size + count
        return numbers

    def bounds(self, probes: np.ndarray) -> np.ndarray:
        """What a row of each cell can score at most, for unit probes: angles obey the triangle inequality."""
        away = np.arccos(np.clip(probes @ self.routes.T, -1.0, 1.0))
        most = np.cos(np.maximum(away - self.angle[:-1], 0.0))
        most[~probes.any(axis=1)] = 0.0
        most = np.hstack([most, np.zeros((len(probes), 1))])
        most[:, self.counts == 0] = -np.inf
        return most


def route_blocks(gallery: DataFrame, block_rows: int = BLOCK_ROWS, most: int = ROUTES) -> RoutedBlocks:
    """Deal a gallery to ``rows / block_rows`` of its vectors, ``most`` at most, chosen by a hash of the id."""
    rows = gallery.where(F.exists("v", lambda x: x != 0))
    wanted = max(1, min(-(-gallery.count() // block_rows), most))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(wanted).select("v").toArrow()
    routes = unit_matrix(chosen["v"]) if len(chosen) else np.zeros((0, vector_width(gallery)))
    held = gallery.sparkSession.sparkContext.broadcast(routes)
    schema = T.StructType(
        [gallery.schema["id"], gallery.schema["v"], T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())]
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = unit_matrix(batch.column("v"))
                cell, angle = np.full(len(vectors), len(held.value)), np.zeros(len(vectors))
                real = vectors.any(axis=1)
                if real.any():
                    near = vectors[real] @ held.value.T
                    cell[real] = near.argmax(axis=1)
                    angle[real] = np.arccos(np.clip(near.max(axis=1), -1.0, 1.0))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], names=schema.names)

    dealt = durable(gallery.select("id", "v").mapInArrow(assign, schema))
    angle, counts = np.zeros(len(routes) + 1), np.zeros(len(routes) + 1, np.int64)
    # one row per routing vector
    for cell, widest, count in dealt.groupBy("cell").agg(F.max("angle"), F.count(F.lit(1))).collect():
        angle[cell], counts[cell] = widest, count
    return RoutedBlocks(routes, angle, counts, dealt.drop("angle"))


def visits(asked: DataFrame, blocks: RoutedBlocks, bundles: np.ndarray, first: bool) -> DataFrame:
    """``(probe_id, v, floor, cell, inner)`` for ``asked(probe_id, v, floor)``.

    The ``first`` time each probe has the cell of its best bound, then all others
    whose bound reaches its floor; without a floor all have to be searched.
    A probe has one row for each bundle, its ``cell``, of the cells ``inner``.
    """
    held = asked.sparkSession.sparkContext.broadcast((blocks.routes, blocks.angle, blocks.counts, bundles))
    added = "cell int, inner array<int>"
    schema = T.StructType([*asked.select("probe_id", "v", "floor").schema, *T.StructType.fromDDL(added).fields])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routes, angle, counts, bundle_of = held.value
        known = RoutedBlocks(routes, angle, counts, None)
        for batch in (whole.slice(low, SLICE_ROWS) for whole in batches for low in range(0, whole.num_rows, SLICE_ROWS)):
            most = known.bounds(unit_matrix(batch.column("v")))
            row, cell = np.arange(len(most)), most.argmax(axis=1)
            if not first:
                floor = batch.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
                reach = most + BOUND_SLACK >= np.where(np.isnan(floor), -2.0, floor)[:, None]
                reach[row, cell] = False
                row, cell = np.nonzero(reach)
            # cells of a bundle are next to each other
            number = bundle_of[cell]
            starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (number[1:] != number[:-1])][: len(row)])
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)).astype(np.int32)), pa.array(cell.astype(np.int32)))
            part = batch.select(["probe_id", "v", "floor"]).take(pa.array(row[starts]))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(number[starts]), lists], names=schema.names)

    return asked.select("probe_id", "v", "floor").mapInArrow(choose, schema)


def score_cells(left: pa.Table, right: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top-k of every probe among the cells ``inner`` that it asks for, of those of a bundle; more rows where ids repeat."""
    ids, vectors, own = right["id"].to_numpy(), unit_matrix(right["v"]), right["inner"].to_numpy()
    _, number, times = np.unique(ids, return_inverse=True, return_counts=True)
    if times.max() > 1:
        # an id counts once, so copies go and ids that still repeat get more places
        kept = np.sort(np.unique(np.column_stack([number, vectors]), axis=0, return_index=True)[1])
        ids, vectors, own = ids[kept], vectors[kept], own[kept]
        k *= int(np.unique(number[kept], return_counts=True)[1].max())
    probes = unit_matrix(left["v"])
    floor = np.nan_to_num(left["floor"].to_numpy().astype(np.float64), nan=-np.inf)
    asked = left["inner"].combine_chunks()
    cells, rows = asked.flatten().to_numpy(), np.repeat(np.arange(len(left)), asked.value_lengths().to_numpy())
    places = np.argsort(own, kind="stable")
    own, parts = own[places], []
    # what is gathered for a probe in passing is several times its result, so probes are taken some at a time
    step = max(1, PLACES // k)
    for low in range(0, len(left), step):
        first, last = np.searchsorted(rows, [low, low + step])
        order = np.argsort(cells[first:last], kind="stable")
        asked_cells, asking = cells[first:last][order], rows[first:last][order]
        found = (np.empty(0, np.int64), ids[:0], np.empty(0))
        for cell in np.unique(own):
            some = asking[np.searchsorted(asked_cells, cell) : np.searchsorted(asked_cells, cell, "right")]
            if not len(some):
                continue
            at = places[np.searchsorted(own, cell) : np.searchsorted(own, cell, "right")]
            more = score_block(some, probes[some], ids[at], vectors[at], k, floor[some])
            found = tuple(np.concatenate(pair) for pair in zip(found, more))
            if len(found[0]) > 2 * k * step:
                best = first_k(*found, k)
                found = tuple(column[best] for column in found)
        best = first_k(*found, k)
        parts.append((found[0][best], found[1][best], found[2][best]))
    row, id_, score = (np.concatenate(column) for column in zip(*parts))
    return left["probe_id"].to_numpy()[row], id_, score


def bounded_search(probes: DataFrame, blocks: RoutedBlocks, k: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """The exact top-k and ``(probe_id, inner)``: the cells that were searched for it."""
    width = blocks.routes.shape[1]
    bundles = blocks.bundles(shipped_rows(block_rows, width))
    number = F.get(F.array(*[F.lit(int(n)) for n in bundles]), F.col("cell"))
    rows = blocks.rows.select("id", "v", number.alias("cell"), F.col("cell").alias("inner"))

    def search(asked: DataFrame) -> DataFrame:
        return blocked_scores(asked, rows, k, block_rows, width, lambda left, right: score_cells(left, right, k))

    none = F.lit(None).cast("double")
    near = durable(visits(probes.select("probe_id", "v", none.alias("floor")), blocks, bundles, True))
    found = durable(keep_best(search(near), k))
    floors = found.where(F.col("rank") == k).select("probe_id", F.col("score").alias("floor"))
    begun = probes.select("probe_id", "v").join(floors, "probe_id", "left")
    # one row for each probe
    far = durable(visits(begun, blocks, np.zeros_like(bundles), False))
    pairs = near.select("probe_id", "inner").unionByName(far.select("probe_id", "inner"))
    asked, searched = far.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("inner")), F.lit(0))).first()
    if searched < SPARSE * asked * int((blocks.counts > 0).sum()):
        asking = visits(far, blocks, bundles, False)
    else:
        asking, rows = far, rows.withColumn("cell", F.lit(0))
    asking = asking.withColumn("base", F.transform("inner", lambda _: F.lit(0.0)))
    more = held_scores(asking, rows.withColumn("tag", F.lit(0)), k, block_rows, width, once=True).drop("tag")
    return keep_best(found.select("probe_id", "id", "score").unionByName(more), k), pairs


def topk_bounded(probes: DataFrame, gallery: DataFrame, k: int, block_rows: int = BLOCK_ROWS, routes: int = ROUTES) -> DataFrame:
    """Exact top-k for two large sides, without the blocks that can hold no row of it.

    The gallery is dealt to cells around routing vectors. Every probe searches
    its best cell first; its k-th score there rules out all cells whose bound is
    lower, so these two are not multiplied. Small cells are shipped in bundles,
    and a probe goes once to each bundle with a cell for it; large ones are cut
    into blocks, as in ``topk_blocked``.
    """
    probes, gallery = usable_sides(probes, gallery)
    return bounded_search(probes, route_blocks(gallery, block_rows, routes), k, block_rows)[0]


def block_report(probes: DataFrame, gallery: DataFrame, k: int, block_rows: int = BLOCK_ROWS, routes: int = ROUTES) -> DataFrame:
    """One row: ``probes``, ``cells``, how many ``pairs`` of both there are, how many were ``searched`` and the share ``skipped``."""
    probes, gallery = usable_sides(probes, gallery)
    blocks = route_blocks(gallery, block_rows, routes)
    cells = int((blocks.counts > 0).sum())
    searched = bounded_search(probes, blocks, k, block_rows)[1].agg(F.coalesce(F.sum(F.size("inner")), F.lit(0)).alias("searched"))
    pairs = F.col("probes") * cells
    return (
        probes.agg(F.count(F.lit(1)).alias("probes"))
        .withColumn("searched", searched.scalar())
        .select("probes", F.lit(cells).alias("cells"), pairs.alias("pairs"), "searched", F.round(1 - F.col("searched") / pairs, 6).alias("skipped"))
    )


def fits_broadcast(df: DataFrame, limit: int) -> bool:
    """Whether the vectors of ``df`` take at most ``limit`` bytes as float64.

    All vectors have the width of the first one here, and ids count with their
    own size. The limit stops the reading of a large table.
    """
    most = limit // (8 * max(vector_width(df), 1))
    ids = F.octet_length(F.col(df.columns[0]).cast("string"))
    rows, size = df.select(ids.alias("n")).limit(most + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return rows <= most and size <= limit


def topk_exact(probes: DataFrame, gallery: DataFrame, k: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Exact ``k`` best gallery rows of every probe.

    A gallery or probes of checked small size are held by every task while the
    other side is read in place; two large sides are cut into blocks, and those
    that can hold no row of the result are left out. All three
    give the same rows. Vectors that are missing, not finite or of another width
    than the gallery's usual one are left out (``left_out`` counts them).
    """
    probes, gallery = usable_sides(probes, gallery)
    if fits_broadcast(gallery, broadcast_bytes):
        return scan_probes(probes, gallery, k)
    if fits_broadcast(probes, broadcast_bytes):
        return scan_gallery(probes, gallery, k)
    return topk_bounded(probes, gallery, k)


def rescore(candidates: DataFrame, probes: DataFrame, gallery: DataFrame) -> DataFrame:
    """Replace candidate scores by the exact cosine of the stored vectors.

    Candidates whose stored vector is missing or zero are dropped.
    """
    stored = gallery.where(is_usable("v")).select("id", F.col("v").alias("_g"))
    asked = probes.where(is_usable("v")).select("probe_id", F.col("v").alias("_p"))
    scored = (
        candidates.drop("score", "distance", "rank")
        .join(stored, "id")
        .join(asked, "probe_id")
        .where(F.size("_g") == F.size("_p"))
        .withColumn("score", F.round(cosine("_p", "_g"), SCORE_DIGITS))
        .drop("_g", "_p")
    )
    return scored.withColumn("distance", F.round(1 - F.col("score"), SCORE_DIGITS))


def rescore_passing(candidates: DataFrame, probes: DataFrame, gallery: DataFrame, k: int, width: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(probe_id, id, score)``: the local ``k`` best of ``rescore``, for many candidates of vectors of one ``width``.

    Probes are held with the lists of their candidates while the gallery passes, so no
    vector goes along with a candidate.
    """
    sized = is_usable("v") & (F.size("v") == width)
    wanted = candidates.where("id IS NOT NULL").groupBy("probe_id").agg(F.collect_list("id").alias("wanted"))
    one = {"cell": F.lit(0), "inner": F.array(F.lit(0)), "base": F.array(F.lit(0.0)), "floor": F.lit(None).cast("double")}
    asked = durable(probes.where(sized).select("probe_id", "v").join(wanted, "probe_id")).withColumns(one)
    stored = gallery.where(sized & F.col("id").isNotNull()).select("id", "v", *[F.lit(0).alias(name) for name in ("cell", "inner", "tag")])
    return held_scores(asked, stored, k, block_rows, width, once=True, keep=HeldCandidates).drop("tag")


def hydrate(candidates: DataFrame, embeddings: DataFrame, subjects: DataFrame, pipeline: str) -> DataFrame:
    """Attach subject and label to candidates; drop rows that are not live.

    Dropped: missing, inactive or other-space embeddings, subjects that are
    not active, and synthetic labels.
    """
    wanted = candidates.select("id").distinct()
    stored = embeddings.where(F.col("is_active") & (F.col("pipeline") == pipeline)).join(wanted, "id", "left_semi")
    people = subjects.where((F.col("status") == "active") & ~is_scale_label("label"))
    live = stored.select("id", "person_id").join(
        people.select(F.col("id").alias("person_id"), "label"), "person_id"
    )
    return candidates.join(live, "id")


def score_pairs(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine per pair, with a status instead of a failure.

    ``pairs`` is ``(pair_id, label_same, key1, key2)``; ``vectors`` is
    ``(key, v, status)`` where ``status`` tells how extraction went.
    """

    def side(n: int) -> DataFrame:
        return vectors.select(F.col("key").alias(f"key{n}"), F.col("v").alias(f"_v{n}"), F.col("status").alias(f"_s{n}"))

    joined = pairs.join(side(1), "key1", "left").join(side(2), "key2", "left")
    missing = F.concat_ws(
        "; ",
        F.when(F.col("_s1").isNull(), F.col("key1").cast("string")),
        F.when(F.col("_s2").isNull(), F.col("key2").cast("string")),
    )
    comparable = is_usable("_v1") & is_usable("_v2") & (F.size("_v1") == F.size("_v2"))
    status = (
        F.when(F.col("_s1").isNull() | F.col("_s2").isNull(), "missing_image")
        .when(F.col("_s1") != "ok", F.col("_s1"))
        .when(F.col("_s2") != "ok", F.col("_s2"))
        .when(~comparable, "error")
        .otherwise("ok")
    )
    return joined.select(
        *[F.col(name) for name in pairs.columns],
        F.when(status == "ok", F.round(cosine("_v1", "_v2"), SCORE_DIGITS)).alias("score"),
        status.alias("status"),
        F.when(status == "missing_image", missing).when(status != "ok", status).otherwise("").alias("error"),
    )


def sum_by_key(keys: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of the vectors of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[starts], np.add.reduceat(vectors[order], starts, axis=0)


def combine_views(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Sum the unit vectors of each key and make the sum a unit vector.

    Vectors are summed batch by batch before the shuffle, so a key with many
    rows sends few; after it each key is a sorted run that is summed in
    passing.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(vec).isNotNull()).select(key, F.col(vec).alias("v"))
    schema = T.StructType([rows.schema[key], T.StructField("v", T.ArrayType(T.DoubleType()))])

    def batch_of(keys: np.ndarray, sums: np.ndarray) -> list[pa.RecordBatch]:
        offsets = pa.array(np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32))
        return as_table(schema, (keys, pa.ListArray.from_arrays(offsets, pa.array(sums.ravel())))).to_batches()

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                yield from batch_of(*sum_by_key(keys, unit_matrix(batch.column(1))))

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last key of a batch may go on in the next one
        open_key, open_sum = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, sums = sum_by_key(batch.column(0).to_numpy(zero_copy_only=False), as_matrix(batch.column(1)))
            if open_sum is not None and open_key == keys[0]:
                sums[0] += open_sum
            elif open_sum is not None:
                yield from batch_of(np.array([open_key]), unit_rows(open_sum[None, :]))
            open_key, open_sum = keys[-1], sums[-1].copy()
            if len(keys) > 1:
                yield from batch_of(keys[:-1], unit_rows(sums[:-1]))
        if open_sum is not None:
            yield from batch_of(np.array([open_key]), unit_rows(open_sum[None, :]))

    ordered = rows.mapInArrow(before, schema).repartition(key).sortWithinPartitions(key)
    return ordered.mapInArrow(after, schema)


def centroid_predictions(df: DataFrame, label: str, vec: str, key: str) -> DataFrame:
    """Label of the nearest class mean, one row per input row.

    Classes go through the same top-k join as any gallery, so their number
    needs no bound.
    """
    unit = df.select(F.col(key).alias("probe_id"), F.col(label).alias("label"), F.col(vec).alias("v"))
    centroids = combine_views(unit, "label", "v").withColumnRenamed("label", "id")
    best = topk_exact(unit.select("probe_id", "v"), centroids, 1)
    return best.select("probe_id", F.col("id").alias("predicted"), "score").join(
        unit.select("probe_id", "label"), "probe_id"
    )


def centroid_accuracy(df: DataFrame, label: str, vec: str, key: str) -> DataFrame:
    hits = centroid_predictions(df, label, vec, key).select((F.col("predicted") == F.col("label")).cast("int").alias("hit"))
    return hits.agg(
        F.count("hit").alias("items"), F.sum("hit").alias("correct"), F.round(F.avg("hit"), 6).alias("accuracy")
    )


def similarity_profile(probe: DataFrame, gallery: DataFrame) -> DataFrame:
    """Average, best and worst cosine of one probe against each identity.

    ``probe`` is one row ``(v)``; ``gallery`` is ``(identity, v)``.
    """
    one = probe.select(F.col("v").alias("_p")).limit(1)
    scored = gallery.withColumn("_p", one.scalar()).withColumn("score", cosine("_p", "v"))
    stats = scored.groupBy("identity").agg(
        F.count("score").alias("items"),
        F.round(F.avg("score"), SCORE_DIGITS).alias("avg_score"),
        F.round(F.max("score"), SCORE_DIGITS).alias("max_score"),
        F.round(F.min("score"), SCORE_DIGITS).alias("min_score"),
    ).where("items > 0")
    best = stats.agg(F.min(F.struct(-F.col("avg_score"), F.col("identity").alias("identity")))["identity"].alias("b"))
    return stats.withColumn("is_best", F.col("identity") == best.scalar())
