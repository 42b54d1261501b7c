"""Scored search: exact filtered top-k, ladders, batches and lookups."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sdlweave.functions.similarity import cosine, query_vector
from sdlweave.operators.predicates import ColumnFilter, MetadataFilter, apply

DEFAULT_LIMIT, MAX_DOCUMENTS, MIN_SIMILARITY, STEP = 10, 50, 0.4, 0.05
OVERFETCH, OVERFETCH_CAP = 5, 10_000


def scored(df: DataFrame, query: Sequence[float], vector: str = "embedding") -> DataFrame:
    """``score`` in double precision; rows without a comparable vector are dropped, the vector is not returned."""
    return df.withColumn("score", cosine(F.col(vector), query_vector(query))).filter(F.col("score").isNotNull()).drop(vector)


def top_k(df: DataFrame, query: Sequence[float], k: int = DEFAULT_LIMIT, metadata: Iterable[MetadataFilter] = (), columns: Iterable[ColumnFilter] = (), key: str = "id", vector: str = "embedding") -> DataFrame:
    """The ``k`` most similar rows that pass the filters; the smaller key wins a tie.

    Filters come before scoring and reach the scan. Planned as a per-task top-k, so nothing is sorted globally.
    """
    return scored(apply(df, metadata, columns), query, vector).orderBy(F.desc("score"), key).limit(k)


def above(df: DataFrame, threshold: float) -> DataFrame:
    """Applied after the limit, as the search does."""
    return df.filter(F.col("score") >= threshold)


def over_fetch(df: DataFrame, query: Sequence[float], k: int, keep: Column, key: str = "id", vector: str = "embedding") -> DataFrame:
    """Post-filtered search: ``min(5k, 10000)`` candidates, then the filter, then ``k``."""
    return scored(df, query, vector).orderBy(F.desc("score"), key).limit(min(k * OVERFETCH, OVERFETCH_CAP)).filter(keep).orderBy(F.desc("score"), key).limit(k)


def rungs(start: float = MIN_SIMILARITY, step: float = STEP) -> list[float]:
    """The thresholds tried, from ``start`` down to 0."""
    out, t = [start], start
    while round(t - step, 2) >= 0:
        t = round(t - step, 2)
        out.append(t)
    return out


def ladder(results: DataFrame, start: float = MIN_SIMILARITY, step: float = STEP) -> DataFrame:
    """Results at the highest rung that any of them reaches, with that rung as ``threshold``.

    Equal to searching again at each rung, since the candidates do not depend on it; one pass.
    """
    best = results.agg(F.max("score").alias("best"))
    tried = F.filter(F.array(*[F.lit(t) for t in rungs(start, step)]), lambda t: t <= F.col("best"))
    return results.join(F.broadcast(best.select(F.array_max(tried).alias("threshold"))), F.col("score") >= F.col("threshold"))


def unit_rows(vectors: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and unit vectors of the rows that can be compared: of the width, finite and not all zero."""
    length = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    if width is None:
        width = int(length[length > 0][0]) if (length > 0).any() else 1
    at = np.flatnonzero(length == width)
    x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)  # null elements are NaN
    ok = np.isfinite(x).all(axis=1) & x.any(axis=1)
    return at[ok].astype(np.int64), x[ok] / np.linalg.norm(x[ok], axis=1, keepdims=True)


def batch_top_k(df: DataFrame, queries: DataFrame, k: int = DEFAULT_LIMIT, key: str = "id", query_key: str = "query_id", vector: str = "embedding", query: str = "query", block: int = 5_000, lists: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """``query_key, key, score, rank`` of a stated set of queries, of one width, against all rows.

    The queries are counted and go to the tasks in blocks of about ``block``. A task multiplies each batch of rows with
    all of them and passes on the ``k`` best a query, so no pair reaches a shuffle that could not win. Vectors that
    cannot be compared take no part; the smaller key wins a tie. With ``lists``, centroids and a number of probes, ``df`` has a
    ``cell`` and a query is compared with the rows of its nearest lists only.
    """
    stated = queries.select(F.col(query_key), F.col(query))
    blocks = max(1, -(-stated.count() // block))
    shape = T.StructType([queries.schema[query_key], df.schema[key], T.StructField("score", T.DoubleType())])
    out = []
    for n in range(blocks):
        part = (stated if blocks == 1 else stated.filter(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == n)).toArrow().combine_chunks()  # a block of queries
        at, q = unit_rows(part.column(1).chunk(0) if part.num_rows else pa.array([], pa.list_(pa.float64())))
        near = None
        if lists is not None and len(q):
            near = np.zeros((len(q), len(lists[0])), bool)
            np.put_along_axis(near, np.argsort(-(q @ lists[0].T), axis=1, kind="stable")[:, : lists[1]], True, axis=1)
        read = df.select(key, vector, *(["cell"] if lists is not None else []))
        out.append(read.mapInArrow(_scorer(part.column(0).take(pa.array(at)).combine_chunks(), q, k, query_key, key, near), shape))
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return reduce(DataFrame.unionByName, out).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _scorer(query_keys: pa.Array, q: np.ndarray, k: int, query_key: str, key: str, near: np.ndarray | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows if len(q) else 0, 2_000):
                b = whole.slice(start, 2_000)
                at, x = unit_rows(b.column(1), q.shape[1])
                if not len(at):
                    continue
                keys = b.column(0).take(pa.array(at))
                order = pc.array_sort_indices(keys).to_numpy()  # by key, so that a stable sort by score breaks ties
                s = q @ x[order].T
                if near is not None:
                    s[~near[:, b.column(2).to_numpy(zero_copy_only=False)[at][order]]] = -2
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                r = np.repeat(np.arange(len(q)), best.shape[1])
                if near is not None:
                    held = s[r, best.ravel()] > -2
                    yield pa.RecordBatch.from_arrays([query_keys.take(pa.array(r[held])), keys.take(pa.array(order[best.ravel()[held]])), pa.array(s[r, best.ravel()][held])], names=[query_key, key, "score"])
                    continue
                yield pa.RecordBatch.from_arrays([query_keys.take(pa.array(r)), keys.take(pa.array(order[best.ravel()])), pa.array(s[r, best.ravel()])], names=[query_key, key, "score"])

    return run


def lookup(df: DataFrame, metadata: Iterable[MetadataFilter] = (), columns: Iterable[ColumnFilter] = (), order: Sequence[str] = ("ordinal",), limit: int | None = None) -> DataFrame:
    """Exact lookup by filters alone; no score is computed."""
    found = apply(df, metadata, columns)
    return found if limit is None else found.orderBy(*order).limit(limit)


def root_fields(df: DataFrame, query: Sequence[float], k: int = MAX_DOCUMENTS, threshold: float = MIN_SIMILARITY, key: str = "id") -> DataFrame:
    """Root operation fields by similarity: the limit first, then the threshold; older rows get their root type."""
    found = top_k(df, query, k, [MetadataFilter("parentType", "in", ["Query", "Mutation", "Subscription"])], key=key)
    return above(found, threshold).withColumn("rootOperationType", F.coalesce("metadata.rootOperationType", "metadata.parentType"))


def limit_per(df: DataFrame, category: str, order: Sequence[str | Column], limit: int = 500) -> DataFrame:
    """At most ``limit`` rows of each category, the first in ``order``."""
    rank = F.row_number().over(Window.partitionBy(category).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")


def score_range(results: DataFrame) -> DataFrame:
    return results.agg(F.min("score").alias("min_score"), F.max("score").alias("max_score"))


def pick_answer(results: DataFrame, answer: str, key: str = "id") -> DataFrame:
    """The row a model's answer names: exact id, else an id within the answer or the answer within an id, else the best."""
    a = F.lit(answer.strip())
    part = a.contains(F.col(key)) | F.col(key).contains(a)
    order = F.when(F.col(key) == a, 0).when(part, 1).otherwise(2)
    return results.orderBy(order, F.desc("score"), key).limit(1)
