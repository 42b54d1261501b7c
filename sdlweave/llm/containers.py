"""Filling fixed-capacity containers (problem 8) by large-item matching on size counts.

Sizes are whole tokens, so a corpus of any size is described by at most ``CAPACITY`` counts, and the packing is
planned on these: items above a third of the capacity are matched greedily, each with the largest partner
that still fits, at most two a container; smaller items then go, largest first, into the smallest gap
that holds them, and new containers open where no gap does. Containers with the same filling are one run
of numbers, so the plan has a few rows per size whatever the number of documents.

Each item finds its container by its rank among the items of its size. Ranks are computed in buckets
of (size, key hash) with the buckets' counts as offsets: one frequent size is spread over many tasks.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sdlweave.llm.tokens import token_counts
from sdlweave.runtime import stage

CAPACITY = 2048
BUCKETS = 256


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int]], int]:
    """Rows ``size, first_rank, container, per``: from that rank on, ``per`` items go to each container in turn.

    Also the number of containers. Sizes are from 1 to the capacity.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    used: dict[int, int] = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []  # the gaps there are, ascending
    total = 0

    def put(size: int, container: int, per: int, n: int) -> None:
        rows.append((size, used[size], container, per))
        used[size] += n
        left[size] -= n

    def free(gap: int, container: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((container, n))

    large = sorted(s for s in left if 3 * s > capacity)
    for a in reversed(large):
        while left[a]:
            i = bisect_left(large, capacity - a + 1) - 1
            while i >= 0 and (large[i] > a or not left[large[i]] or (large[i] == a and left[a] < 2)):
                i -= 1
            if i < 0:
                n = left[a]
                put(a, total, 1, n)
                free(capacity - a, total, n)
            else:
                b = large[i]
                n = left[a] // 2 if a == b else min(left[a], left[b])
                put(a, total, 1, n)
                put(b, total, 1, n)
                free(capacity - a - b, total, n)
            total += n
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            i = bisect_left(order, s)
            if i == len(order):
                free(capacity, total, -(-left[s] // (capacity // s)))
                total += -(-left[s] // (capacity // s))
                i = bisect_left(order, s)
            gap = order[i]
            container, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(i)
            per = gap // s
            full = min(n, left[s] // per)
            if full:
                put(s, container, per, full * per)
                free(gap - per * s, container, full)
            if full < n and left[s]:
                rest = left[s]  # fewer than fill one more container
                put(s, container + full, rest, rest)
                free(gap - rest * s, container + full, 1)
                full += 1
            free(gap, container + full, n - full)
    return rows, total


def _place(rows: list[tuple[int, int, int, int]]):
    rows = sorted(rows)
    key = np.array([(s << 40) + r for s, r, _, _ in rows], dtype=np.int64)
    first, start, per = (np.array([r[k] for r in rows], dtype=np.int64) for k in (1, 2, 3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                size, rank = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64), b.column(3).to_numpy(zero_copy_only=False)
                i = np.searchsorted(key, (size << 40) + rank, side="right") - 1
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(start[i] + (rank - first[i]) // per[i]), b.column(2)], names=["doc_id", "piece_no", "container", "n_tokens"])

    return run


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece_no, container, n_tokens`` for ``sizes(doc_id, n)``.

    An item above the capacity is split into pieces of the capacity and a rest. Items of size 0 (empty and
    null texts) take no space; they are in container 0. Containers count from 0.
    """
    full = F.floor(F.col("n") / capacity).cast("int")
    piece = F.struct(F.col("i").alias("piece_no"), F.least(F.lit(capacity), F.col("n") - F.col("i") * capacity).cast("int").alias("size"))
    items = sizes.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.when(F.col("n") % capacity == 0, full - 1).otherwise(full)))).alias("i")).select("doc_id", piece.alias("p")).select("doc_id", "p.*")
    items = stage(items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(BUCKETS)).cast("int")))
    some = items.filter("size > 0")
    per = some.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("m"))
    counts = {r["size"]: r["n"] for r in per.groupBy("size").agg(F.sum("m").alias("n")).collect()}  # at most `capacity` rows
    rows, _ = plan(counts, capacity)
    offsets = per.withColumn("offset", F.sum("m").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")).drop("m")
    local = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("doc_id", "piece_no")) - 1
    ranked = some.withColumn("local", local).join(offsets, ["size", "bucket"]).select("doc_id", "piece_no", "size", (F.col("offset") + F.col("local")).alias("rank"))
    shape = "doc_id long, piece_no int, container long, n_tokens int"
    placed = ranked.mapInArrow(_place(rows), shape)
    return placed.unionByName(items.filter("size = 0").select("doc_id", "piece_no", F.lit(0).cast("long").alias("container"), F.col("size").alias("n_tokens")))


def containers(docs: DataFrame) -> DataFrame:
    return pack(token_counts(docs))


def checks(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``check_name, n``: documents with a container, containers that are overfull, small texts that were split, pieces out of number."""
    got = stage(containers(docs))
    some = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check_name"), "n")
    per = got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.max("piece_no").alias("last"), F.sum("n_tokens").alias("tokens"))
    return (
        some("documents", per)
        .union(some("overfull", got.groupBy("container").agg(F.sum("n_tokens").alias("t")).filter(F.col("t") > capacity)))
        .union(some("split_small", per.filter((F.col("tokens") <= capacity) & (F.col("pieces") > 1))))
        .union(some("unnumbered", per.filter(F.col("last") + 1 != F.col("pieces"))))
    )
