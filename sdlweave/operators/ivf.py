"""Inverted lists: k-means cells as partitions, of which a query reads the nearest few.

How many that must be depends on the vectors: ``calibrate`` finds the fewest at which a bounded sample reaches the recall asked for.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sdlweave.operators.search import top_k, unit_rows

#: Rows on which the centroids are fitted; all rows are indexed.
FIT_ROWS = 20_000


def _sample(df: DataFrame, key: str, vector: str) -> np.ndarray:
    """Unit vectors of at most FIT_ROWS rows, those with the smallest hashed keys."""
    got = df.filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(FIT_ROWS).select(vector).toArrow().column(0)
    return unit_rows(got.combine_chunks() if got.num_chunks != 1 else got.chunk(0))[1]


def _centroids(x: np.ndarray, lists: int, rounds: int) -> np.ndarray:
    if not len(x):
        return np.zeros((1, 1))
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        for k in range(len(c)):
            if (own == k).any():
                m = x[own == k].sum(0)
                c[k] = m / (np.linalg.norm(m) or 1)
    return c


def fit(df: DataFrame, lists: int = 100, rounds: int = 10, key: str = "id", vector: str = "embedding") -> np.ndarray:
    """Unit centroids by spherical k-means on the sample."""
    return _centroids(_sample(df, key, vector), lists, rounds)


def calibrate(x: np.ndarray, centroids: np.ndarray, target: float, k: int = 10, queries: int = 500) -> int:
    """The fewest lists that hold ``target`` of the true ``k`` nearest of the first ``queries`` vectors, by brute force in the sample."""
    if len(x) < 2:
        return 1
    q = x[:queries]
    s = q @ x.T
    s[np.arange(len(q)), np.arange(len(q))] = -2
    near = np.argsort(-s, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-(q @ centroids.T), axis=1, kind="stable"), axis=1)  # the rank of each list for each query
    ranks = np.take_along_axis(place, (x @ centroids.T).argmax(1)[near], axis=1).ravel()
    return int(np.sort(ranks)[max(0, int(np.ceil(target * len(ranks))) - 1)]) + 1


def fit_calibrated(df: DataFrame, lists: int = 100, target: float = 0.95, rounds: int = 10, key: str = "id", vector: str = "embedding") -> tuple[np.ndarray, int]:
    """Centroids and the number of lists to probe."""
    x = _sample(df, key, vector)
    c = _centroids(x, lists, rounds)
    return c, calibrate(x, c, target)


def assign(df: DataFrame, centroids: np.ndarray, vector: str = "embedding") -> DataFrame:
    """Adds ``cell``, the nearest centroid; -1 for vectors that cannot be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = np.full(b.num_rows, -1, np.int32)
            at, x = unit_rows(b.column(b.schema.get_field_index(vector)), centroids.shape[1])
            if len(at):
                cells[at] = (x @ centroids.T).argmax(1)
            yield b.append_column("cell", pa.array(cells))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType())]))


def probe(indexed: DataFrame, centroids: np.ndarray, query: Sequence[float], k: int = 10, probes: int = 10, key: str = "id", vector: str = "embedding") -> DataFrame:
    """Top-k among the ``probes`` nearest cells; on a table partitioned by ``cell`` only these are read."""
    near = np.argsort(-(centroids @ np.array(query, dtype=np.float64)), kind="stable")[:probes]
    return top_k(indexed.filter(F.col("cell").isin(*map(int, near))), query, k, key=key, vector=vector)
