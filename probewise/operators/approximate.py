"""Approximate top-k: coarse cells, stored product codes, two-pass widening."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probewise.functions.vectors import l2_normalize
from probewise.operators.ordered import HASH_SPACE
from probewise.operators.similarity import (
    BLOCK_ROWS,
    BROADCAST_BYTES,
    PROBE_CHUNK,
    SCORE_DIGITS,
    SINGLE_ERROR,
    SLICE_ROWS,
    SPARSE,
    as_matrix,
    best_of_slices,
    blocked_scores,
    held_scores,
    keep_best,
    rescore,
    rescore_passing,
    topk_blocked,
    unit_matrix,
    usable_rows,
    usual_width,
    vector_width,
)
from probewise.session import durable

# fixed values: defaults of the search and of the offline build
SEED = 42
NLIST, CODE_PARTS, CODE_BITS = 4096, 32, 8
# rows that a centroid is trained on at most, chosen by a hash; all rows are indexed
TRAIN_ROWS_PER_CENTROID = 256
# codes take one byte a part
MOST_BITS = 8
K_FAST, K_SAFE, K_SINGLE = 100, 500, 200
NPROBE, NPROBE_FAST, NPROBE_SAFE = 16, 32, 128
FALLBACK_MARGIN = 0.05
# training rows advised per centroid
ADVISED_ROWS_PER_CENTROID = 39
# candidates that are joined with their vectors at most
JOINED_CANDIDATES = 1_000_000
# centroids that a batch of vectors is compared with at a time
CENTROID_BLOCK = 4096


def training_sample(gallery: DataFrame, rows: int | None, seed: int) -> DataFrame:
    """All vectors, or about ``rows`` of them chosen by a hash of id and seed."""
    if rows is None:
        return gallery.select("id", "v")
    total = gallery.count()
    if total <= rows:
        return gallery.select("id", "v")
    keep = int(HASH_SPACE * rows / total)
    return gallery.select("id", "v").where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(HASH_SPACE)) < keep)


def train_centroids(vectors: DataFrame, k: int, seed: int, measure: str) -> np.ndarray:
    features = vectors.select(array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, distanceMeasure=measure, maxIter=10).fit(features)
    return np.asarray(model.clusterCenters(), dtype=np.float64)


@dataclass
class CellIndex:
    """Gallery rows ``(id, v, cell)`` and the unit centroids of the cells."""

    centroids: np.ndarray
    assigned: DataFrame


def best_cells(vectors: np.ndarray, centroids: np.ndarray, n: int, block: int = CENTROID_BLOCK) -> np.ndarray:
    """The ``n`` best cells of every vector, best first; ties go to the lower cell."""
    best, cells = np.empty((len(vectors), 0)), np.empty((len(vectors), 0), dtype=np.int64)
    for at in range(0, len(centroids), block):
        scores = vectors @ centroids[at : at + block].T
        best = np.hstack([best, scores])
        cells = np.hstack([cells, np.broadcast_to(np.arange(at, at + scores.shape[1]), scores.shape)])
        order = np.argsort(-best, axis=1, kind="stable")[:, :n]
        best, cells = np.take_along_axis(best, order, 1), np.take_along_axis(cells, order, 1)
    return cells


def nearest_cells(
    df: DataFrame, key: str, centroids: np.ndarray, n: int, first: int = 0, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """``(key, v, cell, base)``: the cells at places ``first`` to ``n - 1`` of every vector, best first.

    ``base`` is the inner product with the centroid. Centroids of up to ``limit``
    bytes are held by every task; beyond, they are a gallery that is searched
    in blocks.
    """
    if centroids.nbytes > limit:
        return nearest_cells_blocked(df, key, centroids, n, first)
    held = df.sparkSession.sparkContext.broadcast(centroids)
    schema = T.StructType(
        [df.schema[key], df.schema["v"], T.StructField("cell", T.IntegerType()), T.StructField("base", T.DoubleType())]
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a vector is repeated for each of its cells, so few are taken at a time
        step = max(1, SLICE_ROWS // n)
        for batch in (whole.slice(low, step) for whole in batches for low in range(0, whole.num_rows, step)):
            vectors = as_matrix(batch.column("v")).astype(np.float64, copy=False)
            cells = best_cells(vectors, held.value, n)[:, first:]
            base = np.empty(cells.shape)
            for place in range(cells.shape[1]):
                base[:, place] = np.einsum("ij,ij->i", vectors, held.value[cells[:, place]])
            rows = pa.array(np.repeat(np.arange(batch.num_rows), cells.shape[1]))
            table = pa.Table.from_batches([batch]).take(rows)
            table = table.append_column("cell", pa.array(cells.ravel().astype(np.int32)))
            yield from table.append_column("base", pa.array(base.ravel())).to_batches()

    return df.select(key, "v").mapInArrow(assign, schema)


def nearest_cells_blocked(df: DataFrame, key: str, centroids: np.ndarray, n: int, first: int) -> DataFrame:
    """``nearest_cells`` by a blocked search among the centroids; scores are compared to six digits."""
    spark = df.sparkSession
    rows = durable(df.select(F.monotonically_increasing_id().alias("_row"), F.col(key), "v"))
    offsets = pa.array(np.arange(0, centroids.size + 1, centroids.shape[1], dtype=np.int32))
    table = pa.table({"id": np.arange(len(centroids), dtype=np.int32), "v": pa.ListArray.from_arrays(offsets, pa.array(centroids.ravel()))})
    cells = spark.createDataFrame(table)
    best = topk_blocked(rows.select(F.col("_row").alias("probe_id"), "v"), cells, n).where(F.col("rank") > first)
    numbered = best.select(F.col("probe_id").alias("_row"), F.col("id").alias("cell"))
    joined = rows.join(numbered, "_row").join(cells.select(F.col("id").alias("cell"), F.col("v").alias("_c")), "cell")
    base = F.aggregate(F.zip_with("v", "_c", lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
    return joined.select(key, "v", "cell", base.alias("base"))


def ivf_build(gallery: DataFrame, nlist: int = NLIST, seed: int = SEED, train_rows: int | None = None) -> CellIndex:
    """Train the coarse cells and put every vector into its best one.

    The centroids are fitted on ``train_rows`` vectors at most, by default
    ``TRAIN_ROWS_PER_CENTROID`` a cell; every vector that can be compared is
    put into a cell, the others are left out (``left_out`` counts them). A
    written index is the ``assigned`` table partitioned by cell.
    """
    gallery = usable_rows(gallery, usual_width(gallery))
    train_rows = train_rows or TRAIN_ROWS_PER_CENTROID * nlist
    sample = durable(training_sample(gallery.where(F.exists("v", lambda x: x != 0)), train_rows, seed))
    nlist = min(nlist, sample.count())
    return ivf_assign(gallery, train_centroids(sample, nlist, seed, "cosine"))


def ivf_assign(gallery: DataFrame, centroids: np.ndarray) -> CellIndex:
    """Put every vector into the cell of its best centroid; ties go to the lower cell.

    Vectors that are missing, not finite or of another width than the centroids
    are left out.
    """
    centroids = centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    rows = usable_rows(gallery, centroids.shape[1])
    return CellIndex(centroids, durable(nearest_cells(rows, "id", centroids, 1).select("id", "v", "cell")))


def nearest_lists(df: DataFrame, key: str, centroids: np.ndarray, n: int, first: int = 0, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``(key, v, inner, base)``: as ``nearest_cells``, the cells of a vector and their products as lists.

    Beyond ``limit`` a vector has a row, of lists of one, for each of its cells.
    """
    if centroids.nbytes > limit:
        rows = nearest_cells(df, key, centroids, n, first, limit)
        return rows.select(key, "v", F.array("cell").alias("inner"), F.array("base").alias("base"))
    held = df.sparkSession.sparkContext.broadcast(centroids)
    added = T.StructType.fromDDL("inner array<int>, base array<double>")
    schema = T.StructType([df.schema[key], df.schema["v"], *added.fields])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(low, SLICE_ROWS) for whole in batches for low in range(0, whole.num_rows, SLICE_ROWS)):
            vectors = as_matrix(batch.column("v")).astype(np.float64, copy=False)
            cells = best_cells(vectors, held.value, n)[:, first:]
            base = np.empty(cells.shape)
            for place in range(cells.shape[1]):
                base[:, place] = np.einsum("ij,ij->i", vectors, held.value[cells[:, place]])
            offsets = pa.array(np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1])
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (cells.astype(np.int32), base)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=schema.names)

    return df.select(key, "v").mapInArrow(assign, schema)


def probed_lists(probes: DataFrame, index: CellIndex | CodeIndex, nprobe: int, first: int = 0) -> DataFrame:
    """``(probe_id, v, inner, base)``: the cells at places ``first`` to ``nprobe - 1`` of every probe that can be compared."""
    nprobe = max(1, min(nprobe, len(index.centroids)))
    return nearest_lists(usable_rows(probes, index.centroids.shape[1]), "probe_id", index.centroids, nprobe, first)


def each_cell(listed: DataFrame) -> DataFrame:
    """A row for each cell of the lists, with a ``cell`` and a ``base`` of its own."""
    others = [name for name in listed.columns if name not in ("inner", "base")]
    both = F.arrays_zip(F.col("inner").alias("cell"), F.col("base").alias("base"))
    return listed.select(*others, F.inline(both))


def probed_cells(probes: DataFrame, index: CellIndex | CodeIndex, nprobe: int, first: int = 0) -> DataFrame:
    """``(probe_id, v, cell, base)``: a row for each of the cells of ``probed_lists``; written are the lists."""
    return each_cell(durable(probed_lists(probes, index, nprobe, first)))


def ivf_search(
    probes: DataFrame, index: CellIndex, k: int, nprobe: int = NPROBE, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Top-k among the ``nprobe`` best cells of every probe, scored exactly."""
    return keep_best(CellSearch(index, block_rows).scores(probes, k, 0, nprobe), k)


def rows_of_cells(rows: DataFrame, probed: DataFrame) -> DataFrame:
    """Gallery rows of the probed cells; of a stored index only their folders are read."""
    # at most as many numbers as the driver holds centroids
    cells = [row["cell"] for row in probed.select("cell").distinct().collect()]
    return rows.where(F.col("cell").isin(cells))


def repeated(rows: DataFrame) -> bool:
    """Whether ids are missing or occur more than once."""
    return not rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL").limit(1).isEmpty()


def check_code_shape(dim: int, rows: int, nlist: int, parts: int, bits: int) -> str:
    """Raise for an impossible shape; return a note for a thin training set."""
    needed = max(nlist, 2**bits)
    if dim % parts:
        raise ValueError(f"dimension {dim} cannot be split into {parts} equal parts")
    if rows < needed:
        raise ValueError(f"{rows} vectors are too few, {needed} are needed")
    advised = ADVISED_ROWS_PER_CENTROID * needed
    return f"{rows} training vectors, {advised} advised" if rows < advised else ""


def train_books(pieces: DataFrame, dim: int, parts: int, bits: int, seed: int) -> np.ndarray:
    """Codebooks ``[part, code, element]`` of the vectors ``v``: one clustering per slice."""
    width = dim // parts

    def train(part: int) -> np.ndarray:
        piece = pieces.select(F.slice("v", part * width + 1, width).alias("v"))
        found = train_centroids(piece, 2**bits, seed, "euclidean")
        # equal vectors can give fewer centres than asked for
        return np.vstack([found, np.repeat(found[:1], 2**bits - len(found), axis=0)])

    with ThreadPool(min(parts, 8)) as pool:
        return np.stack(pool.map(train, range(parts)))


def pq_train(gallery: DataFrame, parts: int, bits: int, seed: int = SEED, train_rows: int | None = None) -> np.ndarray:
    """Codebooks of the unit vectors, from ``TRAIN_ROWS_PER_CENTROID`` of them a code at most."""
    dim = vector_width(gallery)
    sample = training_sample(gallery, train_rows or TRAIN_ROWS_PER_CENTROID * 2**bits, seed)
    check_code_shape(dim, sample.count(), 1, parts, bits)
    return train_books(durable(sample.select(l2_normalize("v", "keep").alias("v"))), dim, parts, bits, seed)


@dataclass
class CodeIndex:
    """A search index without vectors: ``coded`` is ``(id, codes, cell)``, a byte for each part.

    With ``residual`` the codes stand for what a unit vector differs from the
    centroid of its cell, else for the unit vector itself.
    """

    centroids: np.ndarray
    books: np.ndarray
    coded: DataFrame
    residual: bool = True


def residual_rows(column, cells, centroids: np.ndarray) -> np.ndarray:
    return unit_matrix(column) - centroids[cells.to_numpy(zero_copy_only=False)]


def residuals(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``v``: unit vectors less the centroid of their cell."""
    held = assigned.sparkSession.sparkContext.broadcast(centroids)

    def subtract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rest = residual_rows(batch.column("v"), batch.column("cell"), held.value)
                offsets = pa.array(np.arange(0, rest.size + 1, rest.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(rest.ravel()))], names=["v"])

    return assigned.select("v", "cell").mapInArrow(subtract, "v array<double>")


def code_train(index: CellIndex, parts: int, bits: int, seed: int = SEED, train_rows: int | None = None) -> np.ndarray:
    """Codebooks of the residuals, from ``TRAIN_ROWS_PER_CENTROID`` of them a code at most."""
    dim = index.centroids.shape[1]
    rows = train_rows or TRAIN_ROWS_PER_CENTROID * 2**bits
    total = index.assigned.count()
    check_code_shape(dim, min(total, rows), 1, parts, bits)
    keep = int(HASH_SPACE * min(1.0, rows / total))
    sample = index.assigned.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(HASH_SPACE)) < keep)
    return train_books(durable(residuals(sample, index.centroids)), dim, parts, bits, seed)


def nearest_codes(vectors: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The number of the nearest centre of every slice; ties go to the lower one."""
    parts, _, width = books.shape
    half = 0.5 * (books**2).sum(axis=2)
    pieces = vectors.reshape(len(vectors), parts, width)
    codes = np.empty((len(vectors), parts), dtype=np.int32)
    for part in range(parts):
        codes[:, part] = np.argmin(half[part] - pieces[:, part] @ books[part].T, axis=1)
    return codes


def pq_encode(gallery: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """Replace ``v`` by ``codes``: per slice the number of the nearest centre."""
    held = gallery.sparkSession.sparkContext.broadcast(codebooks)
    others = [field for field in gallery.schema if field.name != "v"]
    schema = T.StructType([*others, T.StructField("codes", T.ArrayType(T.IntegerType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = nearest_codes(unit_matrix(batch.column("v")), held.value)
            offsets = pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32))
            table = pa.Table.from_batches([batch]).select([f.name for f in others])
            coded = pa.ListArray.from_arrays(offsets, pa.array(codes.ravel()))
            yield from table.append_column("codes", coded).to_batches()

    return gallery.select(*[f.name for f in others], "v").mapInArrow(encode, schema)


def code_index(index: CellIndex, books: np.ndarray, residual: bool = True, save: bool = True) -> CodeIndex:
    """Code every vector of the cells once; the vectors themselves are not kept. Unless saved, the codes are made when read."""
    if books.shape[1] > 2**MOST_BITS:
        raise ValueError(f"{books.shape[1]} codes a part do not fit into a byte")
    held = index.assigned.sparkSession.sparkContext.broadcast((index.centroids, books))
    schema = T.StructType(
        [index.assigned.schema["id"], T.StructField("codes", T.BinaryType()), T.StructField("cell", T.IntegerType())]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, tables = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v")
            rows = residual_rows(v, batch.column("cell"), centroids) if residual else unit_matrix(v)
            codes = nearest_codes(rows, tables).astype(np.uint8)
            packed = pa.array([row.tobytes() for row in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), packed, batch.column("cell")], names=schema.names)

    coded = index.assigned.select("id", "v", "cell").mapInArrow(encode, schema)
    return CodeIndex(index.centroids, books, durable(coded) if save else coded, residual)


class CodedRows:
    """Gallery rows by their codes: a score is ``base`` and the product with the centres that the codes name."""

    def __init__(self, codes: np.ndarray, books: np.ndarray) -> None:
        self.decoded = np.hstack([book[codes[:, part]] for part, book in enumerate(books)])
        self.single = self.decoded.astype(np.float32)
        self.longest = float(np.linalg.norm(self.decoded, axis=1).max(initial=0.0))

    def slack(self, base: np.ndarray, length: float = 1.0) -> float:
        """What a rough score of probes of a ``length`` may be off by, with the rounding."""
        # no partial sum of a score is larger
        most = self.longest * max(length, 1.0) + np.abs(base).max(initial=0.0)
        return 2 * (self.decoded.shape[1] + 4) * SINGLE_ERROR * float(most) + 10.0**-SCORE_DIGITS

    def rough(self, probes: np.ndarray, base: np.ndarray, columns: slice) -> np.ndarray:
        scores = probes.astype(np.float32) @ self.single[columns].T
        scores += base.astype(np.float32)[:, None]
        return scores

    def exact(self, probes: np.ndarray, base: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        return base[row] + np.einsum("ij,ij->i", probes[row], self.decoded[col])


def score_codes(
    probe_ids: np.ndarray, probes: np.ndarray, base: np.ndarray, ids: np.ndarray, codes: np.ndarray, books: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top-k of every unit probe against coded rows of one cell: (probe ids, ids, scores).

    A row's score is ``base`` and the product with the centres that its codes name, in
    double precision for the pairs that can be among the best by the product
    in single precision, so none is missed.
    """
    rows = CodedRows(codes, books)
    slack = rows.slack(base, np.linalg.norm(probes, axis=1).max(initial=1.0))
    found = []
    for start in range(0, len(probe_ids), PROBE_CHUNK):
        chunk, given = probes[start : start + PROBE_CHUNK], base[start : start + PROBE_CHUNK]

        def rough(columns: slice) -> np.ndarray:
            return rows.rough(chunk, given, columns)

        def exact(row: np.ndarray, col: np.ndarray) -> np.ndarray:
            return rows.exact(chunk, given, row, col)

        row, col, score = best_of_slices(ids, k, np.full(len(chunk), -np.inf), slack, rough, exact)
        found.append((probe_ids[start + row], ids[col], score))
    return tuple(np.concatenate(column) for column in zip(*found))


def code_search(
    probes: DataFrame,
    index: CodeIndex,
    k: int,
    nprobe: int = NPROBE,
    rescore_from: DataFrame | None = None,
    widen: int = 4,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Top-k by the inner product with the coded vectors of the probed cells; reads codes only.

    With ``rescore_from`` the best ``widen * k`` are scored again with the
    stored vectors of that table.
    """
    scores = CellSearch(index, block_rows).scores
    if rescore_from is None:
        return keep_best(scores(probes, k, 0, nprobe), k)
    short = keep_best(scores(probes, widen * k, 0, nprobe), widen * k, together=True)
    if probes.count() * widen * k > JOINED_CANDIDATES:
        return keep_best(rescore_passing(short, probes, rescore_from, k, index.centroids.shape[1], block_rows), k)
    return keep_best(rescore(short, probes, rescore_from).select("probe_id", "id", "score"), k)


def pq_search(
    probes: DataFrame,
    index: CellIndex,
    codebooks: np.ndarray,
    k: int,
    nprobe: int = NPROBE,
    rescore_from: DataFrame | None = None,
    widen: int = 4,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``code_search`` with codes of the unit vectors, made for this search."""
    coded = code_index(index, codebooks, residual=False, save=False)
    return code_search(probes, coded, k, nprobe, rescore_from, widen, block_rows)


@dataclass
class CellSearch:
    """Search by cells, of vectors or codes, that can go on with further cells."""

    index: CellIndex | CodeIndex
    block_rows: int = BLOCK_ROWS

    @property
    def rows(self) -> DataFrame:
        return self.index.assigned if isinstance(self.index, CellIndex) else self.index.coded

    def scores(self, probes: DataFrame, k: int, first: int, nprobe: int, tags: int = 1, tag: Column | None = None) -> DataFrame:
        """``(probe_id, id, score, tag)``: local best rows among the cells at places ``first`` to ``nprobe - 1``.

        The column ``tag`` (0 to ``tags - 1``) of the rows says in which table of several they come first, each with
        all rows of the ones before: rows that are among the ``k`` best of a table come out. Without it, where
        ids repeat, the best of each cell and block come out.
        """
        index, rows = self.index, self.rows
        listed = durable(probed_lists(probes, index, nprobe, first))
        rows = rows_of_cells(rows, listed.select(F.explode("inner").alias("cell")))
        width = index.centroids.shape[1]
        if tag is None and repeated(rows):
            return self.block_scores(each_cell(listed), rows, k).withColumn("tag", F.lit(0))
        count = len(index.centroids)
        rows = rows.withColumn("inner", F.col("cell")).withColumn("tag", F.lit(0) if tag is None else tag).where("tag IS NOT NULL")
        listed = listed.withColumn("floor", F.lit(None).cast("double"))
        if min(nprobe, count) - first >= SPARSE * count:
            listed, rows = listed.withColumn("cell", F.lit(0)), rows.withColumn("cell", F.lit(0))
        else:
            one = {"inner": F.array("cell"), "base": F.array("base")}
            listed = each_cell(listed).withColumns(one)
        if isinstance(index, CellIndex):
            return held_scores(listed, rows, k, self.block_rows, width, tags=tags)
        held, residual = probes.sparkSession.sparkContext.broadcast(index.books), index.residual

        if not residual:
            listed = listed.withColumn("base", F.transform("base", lambda _: F.lit(0.0)))
        return held_scores(listed, rows, k, self.block_rows, width, lambda codes: CodedRows(codes, held.value), tags)

    def block_scores(self, probed: DataFrame, rows: DataFrame, k: int) -> DataFrame:
        """The ``k`` best rows of every cell and block for ``probed``, rows of one cell."""
        index = self.index
        if isinstance(index, CellIndex):
            return blocked_scores(probed.drop("base"), rows, k, self.block_rows, index.centroids.shape[1])
        held = probed.sparkSession.sparkContext.broadcast(index.books)
        residual = index.residual

        def score(left: pa.Table, right: pa.Table) -> tuple:
            vectors = as_matrix(left["v"]).astype(np.float64, copy=False)
            lengths = np.linalg.norm(vectors, axis=1)
            lengths[lengths == 0] = 1.0
            base = left["base"].to_numpy() / lengths if residual else np.zeros(len(left))
            codes = np.frombuffer(b"".join(right["codes"].to_pylist()), np.uint8).reshape(len(right), -1)
            return score_codes(
                left["probe_id"].to_numpy(), vectors / lengths[:, None], base, right["id"].to_numpy(), codes, held.value, k
            )

        return blocked_scores(probed, rows, k, self.block_rows, index.centroids.shape[1], score)

    def __call__(self, probes: DataFrame, k: int, nprobe: int) -> DataFrame:
        return keep_best(self.scores(probes, k, 0, nprobe), k)

    def widen(self, probes: DataFrame, kept: DataFrame, k: int, first: int, nprobe: int) -> DataFrame:
        """The ``k`` best of ``kept``, the result for the first ``first`` cells, and the next cells up to ``nprobe``."""
        old = kept.join(probes.select("probe_id").distinct(), "probe_id", "left_semi").select("probe_id", "id", "score")
        if first >= len(self.index.centroids) or nprobe <= first:
            return keep_best(old, k)
        return keep_best(old.unionByName(self.scores(probes, k, first, nprobe).drop("tag")), k)


Search = Callable[[DataFrame, int, int], DataFrame]


def fallback_reason(best, threshold, margin: float = FALLBACK_MARGIN):
    return (
        F.when(best.isNull(), "no_candidates")
        .when(best < threshold, "below_threshold")
        .when(best < threshold + margin, "near_threshold")
    )


def search_dynamic(
    probes: DataFrame,
    search: Search,
    k: int,
    threshold: float,
    mode: str = "dynamic",
    k_fast: int = K_FAST,
    k_safe: int = K_SAFE,
    k_single: int = K_SINGLE,
    exact: bool = False,
    nprobe_fast: int = NPROBE_FAST,
    nprobe_safe: int = NPROBE_SAFE,
    nprobe_single: int = NPROBE,
) -> tuple[DataFrame, DataFrame]:
    """Fast search for all probes, wide search for the doubtful ones.

    ``search(probes, k, nprobe)`` is any top-k search; one that is ``exact``
    finds no better row the second time, so it runs once with the wide ``k``
    and the fast rows are the first ones of it. A ``CellSearch`` keeps the wide
    ``k`` of the fast cells and goes on with the other cells only. Returns the candidates
    and one row per probe ``(probe_id, best_score, search_mode, candidate_k,
    fallback_reason)``.
    """
    if mode in ("live", "single"):
        width = max(k, k_fast if mode == "live" else k_single)
        found = search(probes, width, nprobe_fast if mode == "live" else nprobe_single)
        best = found.groupBy("probe_id").agg(F.max("score").alias("best_score"))
        info = probes.select("probe_id").join(best, "probe_id", "left").select(
            "probe_id",
            "best_score",
            F.lit("live_fast" if mode == "live" else "single").alias("search_mode"),
            F.lit(width).alias("candidate_k"),
            F.lit(None).cast("string").alias("fallback_reason"),
        )
        return found, info

    k_fast = max(k, k_fast)
    k_safe = max(k_fast, k, k_safe)
    cells = isinstance(search, CellSearch)
    if exact or cells:
        everything = durable(search(probes, k_safe, nprobe_fast if cells else nprobe_safe))
        fast = everything.where(F.col("rank") <= k_fast)
    else:
        fast = durable(search(probes, k_fast, nprobe_fast))
    fast_best = fast.groupBy("probe_id").agg(F.max("score").alias("fast_best"))
    judged = probes.select("probe_id").join(fast_best, "probe_id", "left").withColumn(
        "reason", fallback_reason(F.col("fast_best"), F.lit(threshold))
    )
    doubtful = probes.join(judged.where("reason IS NOT NULL").select("probe_id"), "probe_id", "left_semi")
    if cells:
        safe = durable(search.widen(doubtful, everything, k_safe, nprobe_fast, nprobe_safe))
    elif exact:
        safe = everything.join(doubtful.select("probe_id"), "probe_id", "left_semi")
    else:
        safe = durable(search(doubtful, k_safe, nprobe_safe))
    safe_best = safe.groupBy("probe_id").agg(F.max("score").alias("safe_best"))
    widened = F.col("safe_best").isNotNull() & (
        F.col("fast_best").isNull() | (F.col("safe_best") >= F.col("fast_best"))
    )
    info = (
        judged.join(safe_best, "probe_id", "left")
        .withColumn("_wide", F.coalesce(widened, F.lit(False)))
        .select(
            "probe_id",
            F.when(F.col("_wide"), F.col("safe_best")).otherwise(F.col("fast_best")).alias("best_score"),
            F.when(F.col("_wide"), "safe_fallback").otherwise("fast").alias("search_mode"),
            F.when(F.col("_wide"), k_safe).otherwise(k_fast).alias("candidate_k"),
            F.when(F.col("_wide"), F.col("reason")).alias("fallback_reason"),
        )
    )
    wide = info.where(F.col("search_mode") == "safe_fallback").select("probe_id")
    found = safe.join(wide, "probe_id", "left_semi").unionByName(fast.join(wide, "probe_id", "left_anti"))
    return found, info
