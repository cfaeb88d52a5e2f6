"""An inverted-file index for cosine search: every vector is indexed, a question reads the nearest cells only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.operators.retrieval import best, blockwise

#: Centroids are fitted on at most this many vectors, those of the smallest hash.
FIT_ROWS = 20_000
MOST_CELLS = 1_024


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def fit_cells(vectors: DataFrame, key: str, vector_col: str, cells: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids by spherical k-means over the bounded sample."""
    rows = vectors.where(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(key)).limit(FIT_ROWS).select(vector_col).toArrow()
    if not rows.num_rows:
        return np.zeros((1, 1))
    sample = _matrix(rows.column(0).combine_chunks())
    rng = np.random.default_rng(0)
    centers = sample[rng.choice(len(sample), size=min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(sample @ centers.T, axis=1)
        for c in range(len(centers)):
            mine = sample[near == c]
            if len(mine):
                total = mine.sum(axis=0)
                centers[c] = total / max(np.linalg.norm(total), 1e-300)
    return centers


def in_cells(vectors: DataFrame, key: str, vector_col: str, centers: np.ndarray, probes: int) -> DataFrame:
    """(key, cell, v): each vector under its ``probes`` nearest cells; 1 to index, more to ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _matrix(batch.column(1))
            near = np.argsort(-(unit @ centers.T), axis=1, kind="stable")[:, :probes]
            take = pa.array(np.repeat(np.arange(len(unit)), near.shape[1]))
            flat = unit[take.to_numpy()].ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, unit.shape[1], dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(near.ravel().astype(np.int32)), lists], names=[key, "cell", "v"])

    picked = vectors.where(F.col(vector_col).isNotNull()).select(F.col(key).cast("bigint").alias(key), vector_col)
    return picked.mapInArrow(run, f"{key} bigint, cell int, v array<double>")


def probes_for(vectors: DataFrame, key: str, vector_col: str, centers: np.ndarray, k: int, recall: float) -> int:
    """The fewest cells to probe that reach the recall for vectors of the bounded sample among the sample."""
    rows = vectors.where(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(key)).limit(FIT_ROWS).select(vector_col).toArrow()
    if not rows.num_rows:
        return 1
    sample = _matrix(rows.column(0).combine_chunks())
    asked = sample[:: max(1, len(sample) // 300)]
    cell = np.argmax(sample @ centers.T, axis=1)
    exact = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, :k]
    order = np.argsort(-(asked @ centers.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # at which probe a cell is read
    needed = np.take_along_axis(place, cell[exact], axis=1).ravel()
    return int(np.sort(needed)[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def search(vectors: DataFrame, key: str, vector_col: str, questions: DataFrame, question_key: str, question_vector: str, k: int, recall: float = 0.95) -> DataFrame:
    """(question, key, score, rank): approximate cosine top k; a cell is joined with the questions that probe it.

    There are about as many cells as the square root of the vectors, at most MOST_CELLS; as many are probed as the
    sample needs for the recall asked for. Cells are scored in blocks.
    """
    cells = int(min(MOST_CELLS, max(1, vectors.count() ** 0.5)))
    centers = fit_cells(vectors, key, vector_col, cells)
    probes = probes_for(vectors, key, vector_col, centers, k, recall)
    index = in_cells(vectors, key, vector_col, centers, 1).select(F.col(key).alias("key"), F.col("cell").cast("long").alias("g"), "v")
    asked = in_cells(questions, question_key, question_vector, centers, probes).select(F.col(question_key).alias("question"), F.col("cell").cast("long").alias("g"), "v")
    return best(blockwise(asked, index, key, k), "question", key, "score", k)
