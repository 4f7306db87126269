"""Exact top-k by inner product, best first in M-trees.

Vectors are whole numbers. Their distance is Euclidean, and an inner product
follows from it: ``q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2``. So a lower bound of
the distance and the largest norm below a node bound every score there.

The vectors are dealt to the nearest of some routing vectors and each such cell
is cut into trees of about ``TREE_ROWS``. A tree is a table of pages. An entry
of an inner page is a routing object with the radius that covers what lies
below, its distance to the page's own routing object, the largest norm below
and the number of the page; an entry of a leaf page is a vector. A query walks
the pages of a tree best bound first, until the best bound left is below its
k-th score. In a page the triangle inequality on the stored distances rules
entries out before a distance is computed.

A query first searches one tree of the cell with the best bound. Its k-th score
there rules out cells for it, and it begins with that score in the trees of all
others, block by block. Every bound is used strictly, so ties are never lost.
Vectors that repeat stay ``k + 1`` times at most before the trees are built,
with their smallest ids, because no more can be among the best of any query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probewise.llm.common import query, read
from probewise.session import durable

#: Entries of a page, and vectors of a tree, at most or about.
PAGE = 512
TREE_ROWS = 8192
#: Cells at most, so their routing vectors fit into every task; large cells have many trees.
CELLS = 1024
#: Queries that meet a tree in one task, about.
QUERY_ROWS = 4096
#: Products of whole numbers below it are exact in floating point.
EXACT = 2.0**53
#: Stands for a null id, which is the last among equal scores.
NO_ID = 2**63 - 1

ROW = "id long, x array<long>"
PAGES = "cell int, tree int, page int, leaf boolean, width int, refs array<long>, objects array<long>, radius array<double>, norm array<double>, peak array<double>, to_parent array<double>"


def whole_vectors(df: DataFrame, key: str, vec: str, scale: int) -> DataFrame:
    """``id, x``: every component as ``floor(scale * component)``.

    Vectors that are null or have a component that is null or not finite are left
    out, as are repeats of id and vector.
    """
    v = F.col(vec)
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    x = F.transform(v, lambda e: F.floor(e.cast("double") * scale))
    return df.where(v.isNotNull() & finite).select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), x.alias("x")).distinct()


def matrix_of(column: pa.ListArray, width: int | None = None) -> np.ndarray:
    """A list column as a matrix of whole numbers; shorter rows end in zeros."""
    lengths = np.asarray(column.value_lengths(), np.int64)
    width = max(int(lengths.max(initial=0)), 1) if width is None else width
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(lengths) * width:
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def exact(matrix: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides padded to one width, in a type in which their products are exact."""
    width = max(matrix.shape[1], other.shape[1])
    sides = [np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (matrix, other)]
    largest = max(float(np.abs(m.astype(np.float64)).max(initial=0)) for m in sides)
    kind = np.float64 if width * largest**2 < EXACT else object
    return sides[0].astype(kind), sides[1].astype(kind)


def squares(matrix: np.ndarray) -> np.ndarray:
    return (matrix * matrix).sum(axis=1)


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``left`` to all of ``right``."""
    found = squares(left)[:, None] + squares(right)[None, :] - 2 * (left @ right.T)
    return np.sqrt(np.maximum(found.astype(np.float64), 0.0))


@dataclass
class Page:
    """Entries of a node: routing objects or, in a leaf, vectors."""

    leaf: bool
    refs: np.ndarray
    objects: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    peak: np.ndarray
    to_parent: np.ndarray


def build_tree(ids: np.ndarray, vectors: np.ndarray, size: int = PAGE) -> list[Page]:
    """The pages of a tree, the root first. Loaded from above: routing objects are spread over the rows."""
    pages: list[Page | None] = []
    norms = squares(vectors).astype(np.float64)

    def load(rows: np.ndarray, route: np.ndarray | None) -> int:
        number = len(pages)
        pages.append(None)
        if len(rows) <= size:
            objects = vectors[rows]
            to_parent = distances(objects, route[None, :])[:, 0] if route is not None else np.zeros(len(rows))
            pages[number] = Page(True, ids[rows], objects, np.zeros(len(rows)), norms[rows], norms[rows], to_parent)
            return number
        n = min(size, -(-2 * len(rows) // size))
        routes = rows[np.linspace(0, len(rows) - 1, n).astype(np.int64)]
        far = distances(vectors[rows], vectors[routes])
        owner = far.argmin(axis=1)
        if (owner == owner[0]).all():
            # nothing tells the rows apart, so they are dealt out evenly
            owner = np.arange(len(rows)) * n // len(rows)
        refs, radius, peak, used = [], [], [], []
        for i in range(n):
            own = owner == i
            if own.any():
                refs.append(load(rows[own], vectors[routes[i]]))
                radius.append(far[own, i].max())
                peak.append(norms[rows[own]].max())
                used.append(routes[i])
        objects = vectors[used]
        to_parent = distances(objects, route[None, :])[:, 0] if route is not None else np.zeros(len(used))
        pages[number] = Page(False, np.array(refs, np.int64), objects, np.array(radius), norms[used], np.array(peak), to_parent)
        return number

    if len(ids):
        load(np.arange(len(ids)), None)
    return pages


def bounds(square: float, peak: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Scores at most, given the least distance and the largest squared norm; a little above, for rounding."""
    near = (square + peak - least**2) / 2
    return np.minimum(near, np.sqrt(square * peak)) + 1e-9 * (square + peak) + 0.5


def best_first(pages: list[Page], q: np.ndarray, own: int, k: int, floor: float = -np.inf, seen: list[int] | None = None):
    """``ids, scores`` of the ``k`` best vectors of a tree but those of id ``own``.

    Scores below ``floor`` may be missing. ``seen`` counts the distances and
    products that were computed.
    """
    square = float(q @ q)
    limit = floor
    best_ids, best = np.empty(0, np.int64), np.empty(0, q.dtype)
    heap = [(-np.inf, 0, None)] if pages else []
    while heap:
        bound, number, near = heapq.heappop(heap)
        if -bound < limit:
            break
        page = pages[number]
        entries = np.arange(len(page.refs))
        if near is not None:
            # stored distances alone: the triangle inequality on the page's routing object
            least = np.maximum(np.abs(near - page.to_parent) - page.radius, 0.0)
            entries = entries[bounds(square, page.peak, least) >= limit]
        if seen is not None:
            seen.append(len(entries))
        scores = page.objects[entries] @ q
        if not page.leaf:
            away = np.sqrt(np.maximum(square + page.norm[entries] - 2 * scores.astype(np.float64), 0.0))
            most = bounds(square, page.peak[entries], np.maximum(away - page.radius[entries], 0.0))
            for entry, top, distance in zip(entries.tolist(), most.tolist(), away.tolist()):
                if top >= limit:
                    heapq.heappush(heap, (-top, int(page.refs[entry]), distance))
            continue
        found = page.refs[entries]
        able = (scores >= limit) & (found != own)
        best_ids, best = np.concatenate([best_ids, found[able]]), np.concatenate([best, scores[able]])
        order = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[order], best[order]
        if len(best) == k:
            limit = max(limit, float(best[-1]))
    return best_ids, best


def as_lists(matrix: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, max(matrix.shape[1], 1), dtype=np.int32)), pa.array(matrix.ravel(), kind))


def stored_pages(rows: pa.Table, cell: int, tree: int) -> pa.Table:
    """The pages of a tree over ``rows(id, x)`` as rows of ``PAGES``."""
    vectors = matrix_of(rows["x"].combine_chunks())
    order = np.argsort(rows["id"].to_numpy(), kind="stable")
    pages = build_tree(rows["id"].to_numpy()[order], exact(vectors[order], vectors[:1])[0])
    number = [pa.array([p], pa.int32()) for p in range(len(pages))]
    return pa.concat_tables(
        pa.table(
            {
                "cell": pa.array([cell], pa.int32()),
                "tree": pa.array([tree], pa.int32()),
                "page": number[i],
                "leaf": pa.array([page.leaf]),
                "width": pa.array([vectors.shape[1]], pa.int32()),
                "refs": as_lists(page.refs[None, :], pa.int64()),
                "objects": as_lists(page.objects.astype(np.int64).reshape(1, -1), pa.int64()),
                **{name: as_lists(getattr(page, name)[None, :], pa.float64()) for name in ("radius", "norm", "peak", "to_parent")},
            }
        )
        for i, page in enumerate(pages)
    )


def read_pages(rows: pa.Table) -> tuple[list[Page], np.ndarray]:
    """The pages that ``stored_pages`` made, and their largest components."""
    rows = rows.sort_by("page")
    pages = []
    for row in range(len(rows)):
        value = {name: rows[name][row].values.to_numpy(zero_copy_only=False) for name in ("refs", "objects", "radius", "norm", "peak", "to_parent")}
        objects = value["objects"].reshape(-1, rows["width"][row].as_py())
        pages.append(Page(rows["leaf"][row].as_py(), value["refs"], objects, value["radius"], value["norm"], value["peak"], value["to_parent"]))
    most = np.max([np.abs(page.objects.astype(np.float64)).max(axis=0, initial=0) for page in pages], axis=0)
    return pages, most


def search_tree(tree: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The best of a tree for the queries ``asked(id, x, floor)``."""
    out: tuple[list, list, list] = ([], [], [])
    if len(tree) and len(asked):
        pages, most = read_pages(tree)
        queries = matrix_of(asked["x"].combine_chunks())
        # one type for the tree and all queries
        kind = exact(queries, most.astype(np.int64)[None, :])[0].dtype
        width = max(queries.shape[1], len(most))
        for page in pages:
            page.objects = np.pad(page.objects, ((0, 0), (0, width - page.objects.shape[1]))).astype(kind)
        queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1]))).astype(kind)
        floors = asked["floor"].to_numpy(zero_copy_only=False)
        for key, q, floor in zip(asked["id"].to_pylist(), queries, floors):
            ids, scores = best_first(pages, q, key, k, -np.inf if np.isnan(floor) else floor)
            out[0].extend([key] * len(ids))
            out[1].extend(ids.tolist())
            out[2].extend(min(max(int(s), -(2**63)), 2**63 - 1) for s in scores)
    return pa.table({"query_id": pa.array(out[0], pa.int64()), "id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})


def best_of(found: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, id, score`` of the ``k`` best rows of every query; ties to the smaller id."""
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


@dataclass
class Forest:
    """Trees of all vectors: stored pages, the cells' routing vectors and what they cover."""

    pages: DataFrame
    routes: np.ndarray
    radius: np.ndarray
    peak: np.ndarray
    trees: np.ndarray


def nearest_route(rows: DataFrame, routes: np.ndarray) -> DataFrame:
    """``id, x, cell, away, norm``: the nearest routing vector and the distance to it."""
    held = rows.sparkSession.sparkContext.broadcast(routes)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors, centres = exact(matrix_of(batch.column(1)), held.value)
                away = distances(vectors, centres)
                cell = away.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns,
                        pa.array(cell.astype(np.int32)),
                        pa.array(away[np.arange(len(cell)), cell]),
                        pa.array(squares(vectors).astype(np.float64)),
                    ],
                    names=["id", "x", "cell", "away", "norm"],
                )

    return rows.select("id", "x").mapInArrow(assign, f"{ROW}, cell int, away double, norm double")


def plant(vectors: DataFrame, k: int, tree_rows: int = TREE_ROWS, cells: int = CELLS) -> Forest | None:
    """Trees of ``vectors(id, x)``, good for searches of up to ``k`` rows; None without rows.

    Routing vectors are ``rows / tree_rows`` of the rows, ``cells`` at most,
    by a hash of the id; every row is in a tree.
    """
    copy = Window.partitionBy("x").orderBy("id")
    rows = durable(vectors.withColumn("_copy", F.row_number().over(copy)).where(F.col("_copy") <= k + 1).select("id", "x"))
    n = rows.count()
    if not n:
        return None
    chosen = rows.orderBy(F.xxhash64("id"), "id", "x").limit(min(-(-n // tree_rows), cells)).select("x").distinct().toArrow()
    routes = matrix_of(chosen["x"].combine_chunks())
    dealt = durable(nearest_route(rows, routes))
    stats = dealt.groupBy("cell").agg(F.max("away"), F.max("norm"), F.ceil(F.count(F.lit(1)) / tree_rows)).collect()
    radius, peak, trees = np.zeros(len(routes)), np.zeros(len(routes)), np.zeros(len(routes), np.int64)
    for cell, away, norm, count in stats:
        radius[cell], peak[cell], trees[cell] = away, norm, count
    counts = F.array(*[F.lit(int(t)) for t in trees])
    tree = F.pmod(F.xxhash64("id", "x"), F.get(counts, F.col("cell"))).cast("int")

    def build(keys: tuple, table: pa.Table) -> pa.Table:
        return stored_pages(table, keys[0].as_py(), keys[1].as_py())

    pages = dealt.select("cell", tree.alias("tree"), "id", "x").groupBy("cell", "tree").applyInArrow(build, PAGES)
    return Forest(durable(pages), routes, radius, peak, trees)


def visit(forest: Forest, asked: DataFrame, k: int, blocks: int) -> DataFrame:
    """``query_id, id, score``: the best of every tree for the queries ``asked(cell, tree, id, x, floor)``."""
    left = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    right = forest.pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["cell", "tree", "block"]
    return (
        right.groupBy(*keys)
        .cogroup(left.groupBy(*keys))
        .applyInArrow(lambda tree, part: search_tree(tree, part, k), "query_id long, id long, score long")
    )


def cells_to_visit(asked: DataFrame, forest: Forest, first: bool) -> DataFrame:
    """``id, x, floor, cell``: for each query the cell of the best bound, or all but that one that its floor allows."""
    sc = asked.sparkSession.sparkContext
    held = sc.broadcast((forest.routes, forest.radius, forest.peak, forest.trees))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routes, radius, peak, trees = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, centres = exact(matrix_of(batch.column(1)), routes)
            norms = squares(vectors).astype(np.float64)[:, None]
            most = bounds(norms, peak[None, :], np.maximum(distances(vectors, centres) - radius[None, :], 0.0))
            most[:, trees == 0] = -np.inf
            best = most.argmax(axis=1)
            floors = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            if first:
                row, cell = np.arange(len(best)), best
            else:
                row, cell = np.nonzero((most >= np.where(np.isnan(floors), -np.inf, floors)[:, None]) & (trees > 0)[None, :])
            home = pa.array(best[row] == cell)
            yield pa.RecordBatch.from_arrays(
                [*batch.take(pa.array(row)).columns, pa.array(cell.astype(np.int32)), home], names=["id", "x", "floor", "cell", "home"]
            )

    return asked.select("id", "x", "floor").mapInArrow(choose, f"{ROW}, floor double, cell int, home boolean")


def search(forest: Forest, queries: DataFrame, k: int, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` best rows of all trees for every row of ``queries(id, x)``."""
    none = F.lit(None).cast("double")
    asked = durable(queries.withColumn("floor", none))
    blocks = -(-asked.count() // query_rows) or 1
    trees = F.get(F.array(*[F.lit(int(t)) for t in forest.trees]), F.col("cell"))
    seed = F.pmod(F.xxhash64("id"), trees).cast("int")

    near = cells_to_visit(asked, forest, True).withColumn("tree", seed)
    found = durable(best_of(visit(forest, near, k, blocks), k))
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
    begun = asked.drop("floor").join(full, "id", "left")
    others = (
        cells_to_visit(begun, forest, False)
        .withColumn("tree", F.explode(F.sequence(F.lit(0), (trees - 1).cast("int"))))
        .where(~(F.col("home") & (F.col("tree") == seed)))
    )
    more = visit(forest, others, k, blocks)
    return best_of(found.select("query_id", "id", "score").unionByName(more), k)


def topk_inner(
    rows: DataFrame,
    asked: Column,
    k: int,
    key: str = "vec_id",
    vec: str = "embedding",
    scale: int = 256,
    tree_rows: int = TREE_ROWS,
    cells: int = CELLS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other rows for each row that ``asked`` tells.

    Components become ``floor(scale * component)``, scores are whole inner
    products, ties go to the smaller id and a null id comes last. Vectors that
    are null or have a null or not finite component take no part. Vectors of
    other widths are taken as if they ended in zeros. Rows that repeat id and
    vector count once; rows that share a query's id are its own and no
    candidates, and the least of their vectors asks. A row with a null id asks
    nothing. Scores beyond 64 bits stand at the end of their range. No rows, or
    no queries, give no rows; other columns are not read.
    """
    vectors = durable(whole_vectors(rows, key, vec, scale))
    empty = "query_id long, rank int, vec_id long, score long"
    forest = plant(vectors, k, tree_rows, cells)
    if forest is None:
        return rows.sparkSession.createDataFrame([], empty)
    queries = vectors.where(asked & (F.col("id") != NO_ID)).groupBy("id").agg(F.min("x").alias("x"))
    found = search(forest, queries, k, query_rows)
    return found.select("query_id", "rank", F.when(F.col("id") != NO_ID, F.col("id")).alias("vec_id"), "score")


@query(
    "op13_mtree_topk",
    """
    WITH whole AS (
        SELECT DISTINCT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
        FROM whole q JOIN whole c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
    )
    SELECT query_id, rank::INT AS rank, vec_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
    WHERE rank <= 5
    """,
)
def op13_mtree_topk(spark, sf_dir):
    return topk_inner(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)
