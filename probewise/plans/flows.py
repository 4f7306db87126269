"""End-to-end flows: search, index build, verification."""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probewise.functions.vectors import decode_vector, decrypt_payload
from probewise.operators.approximate import CellIndex, CodeIndex, Search, code_index, code_train, ivf_build, search_dynamic
from probewise.operators.decisions import (
    aggregate_identities,
    dedup_identities,
    gate_identities,
    rank_identities,
    reject_ambiguous,
    summarize_search,
)
from probewise.operators.gallery import live_embeddings
from probewise.operators.similarity import as_gallery, as_probes, hydrate, rescore, topk_exact
from probewise.operators.vector_tables import valid_rows, validate_vectors
from probewise.session import durable


class ImageSearch:
    """Identify the faces ``(image_id, face_index, probe_id, v)`` of many images.

    ``embeddings`` needs a ``v`` column and may hold several spaces and rows
    that are not live; ``search`` defaults to exact search over the space. The
    tables between the steps are attributes, computed when first asked for;
    those read more than once are written to the checkpoint folder.
    """

    def __init__(
        self,
        faces: DataFrame,
        embeddings: DataFrame,
        subjects: DataFrame,
        pipeline: str,
        threshold: float,
        k: int,
        mode: str = "dynamic",
        search: Search | None = None,
        **widths: int,
    ) -> None:
        self.faces = durable(faces.select("image_id", "face_index", "probe_id", "v"))
        self.places = self.faces.select("probe_id", "image_id", "face_index")
        self.probes = as_probes(self.faces, "v", "probe_id")
        self.embeddings, self.subjects = embeddings, subjects
        self.pipeline, self.threshold, self.k = pipeline, float(threshold), k
        self.indexed = as_gallery(embeddings.where(F.col("pipeline") == pipeline), "v", "id")
        self.mode, self.widths, self.exact = mode, widths, search is None
        self.search = search or (lambda probes, width, nprobe: topk_exact(probes, self.indexed, width))

    @cached_property
    def found(self) -> tuple[DataFrame, DataFrame]:
        return search_dynamic(self.probes, self.search, self.k, self.threshold, self.mode, exact=self.exact, **self.widths)

    @property
    def candidates(self) -> DataFrame:
        return self.found[0]

    @property
    def probe_info(self) -> DataFrame:
        """One row per face: how it was searched and its best raw score."""
        return self.places.join(self.found[1], "probe_id")

    @property
    def scored(self) -> DataFrame:
        """Live candidates with their exact scores."""
        hydrated = hydrate(self.candidates, self.embeddings, self.subjects, self.pipeline)
        exact = rescore(hydrated, self.probes, self.indexed).join(self.places, "probe_id")
        return exact.withColumns({"pipeline": F.lit(self.pipeline), "threshold": F.lit(self.threshold)})

    @cached_property
    def identities(self) -> DataFrame:
        return durable(aggregate_identities(self.scored))

    @property
    def gated(self) -> DataFrame:
        return gate_identities(self.identities, self.places)

    @property
    def ranked(self) -> DataFrame:
        return rank_identities(reject_ambiguous(self.gated), self.k)

    @property
    def results(self) -> DataFrame:
        return dedup_identities(self.ranked)

    @property
    def summary(self) -> DataFrame:
        """One row per image."""
        return summarize_search(self.results, self.probe_info)


def build_index(
    embeddings: DataFrame,
    subjects: DataFrame,
    pipeline: str,
    model: str,
    dim: int,
    nlist: int,
    key_hex: str | None = None,
) -> CellIndex:
    """Index the live stored payloads ``vector`` of one space."""
    live = live_embeddings(embeddings, subjects, pipeline, model)
    payload = decrypt_payload("vector", key_hex) if key_hex else F.col("vector")
    decoded = live.select("id", decode_vector(payload, dim).alias("v"))
    good = valid_rows(validate_vectors(decoded, dim))
    return ivf_build(good.select("id", "v"), nlist)


def build_code_index(
    embeddings: DataFrame,
    subjects: DataFrame,
    pipeline: str,
    model: str,
    dim: int,
    nlist: int,
    parts: int,
    bits: int,
    key_hex: str | None = None,
) -> CodeIndex:
    """Cells and residual codes of the live stored payloads of one space."""
    index = build_index(embeddings, subjects, pipeline, model, dim, nlist, key_hex)
    return code_index(index, code_train(index, parts, bits))


def write_cells(rows: DataFrame, path: str) -> None:
    """Parquet with a folder per cell.

    Rebalancing splits the files of a large cell over several tasks and puts
    small cells together.
    """
    rows.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(path)


def write_matrix(spark: SparkSession, matrix: np.ndarray, path: str) -> None:
    rows = [(number, row.tolist()) for number, row in enumerate(matrix)]
    spark.createDataFrame(rows, "row int, v array<double>").write.mode("overwrite").parquet(path)


def read_matrix(spark: SparkSession, path: str) -> np.ndarray:
    """A stored matrix; it is as large as the one that the driver trained and wrote."""
    return np.array([row["v"] for row in spark.read.parquet(path).orderBy("row").collect()])


def write_index(index: CellIndex, path: str) -> None:
    """Store an index as parquet: vectors by cell, and the centroids."""
    write_cells(index.assigned, f"{path}/vectors")
    write_matrix(index.assigned.sparkSession, index.centroids, f"{path}/centroids")


def read_index(spark: SparkSession, path: str) -> CellIndex:
    return CellIndex(read_matrix(spark, f"{path}/centroids"), spark.read.parquet(f"{path}/vectors"))


def write_codes(index: CodeIndex, path: str) -> None:
    """Store a code index as parquet: codes by cell, the centroids and the codebooks; no vectors."""
    spark = index.coded.sparkSession
    write_cells(index.coded, f"{path}/codes")
    write_matrix(spark, index.centroids, f"{path}/centroids")
    parts, codes, width = index.books.shape
    write_matrix(spark, index.books.reshape(-1, width), f"{path}/books")
    shape = [(parts, codes, index.residual)]
    spark.createDataFrame(shape, "parts int, codes int, residual boolean").write.mode("overwrite").parquet(f"{path}/shape")


def read_codes(spark: SparkSession, path: str) -> CodeIndex:
    parts, codes, residual = spark.read.parquet(f"{path}/shape").first()
    books = read_matrix(spark, f"{path}/books").reshape(parts, codes, -1)
    return CodeIndex(read_matrix(spark, f"{path}/centroids"), books, spark.read.parquet(f"{path}/codes"), residual)
