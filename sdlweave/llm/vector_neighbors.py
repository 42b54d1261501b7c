"""Most similar vectors for every vector (problem 2) by stable projections and a kd-tree.

Unit vectors are projected to ``DIMS`` dimensions by fixed Gaussian directions, a 2-stable projection: the
squared projected distance over the squared true distance follows a chi-square law with DIMS degrees of
freedom. On a bounded sample, prototypes are chosen that cover it, and a kd-tree over their projections
makes groups of near prototypes. Every row goes to the cell of its nearest prototype; rows too far
from any are *outer* rows, the others *inner* rows. A cell's radius and the box of its projections are
exact, taken over all its inner rows.

The stopping test: the search goes on while ``chi2_cdf(projected_distance^2 / kth_distance^2) < CONFIDENCE``. A row visits the
groups with a cell for which it does, the k-th distance being the one that belongs to similarity 0.85 (a stated query's comes
from the sample). In a block the rows lie in the leaves of a kd-tree over their projections. Each query takes the leaves in the
order of their projected distance, verifies their vectors, in double precision at the end, lowers its k-th distance by what it
found, and ends when the next leaf fails the test; one to which the test leaves much of the block open verifies the block. The triangle inequality in the full space also closes leaves and cells,
which loses nothing; so only what the test closed can be missed.

Inner rows do not look for outer rows: an outer row visits the cells near it and the pair is entered in both
lists. Outer rows meet each other in a block of their own; where they are too many for one, they are the rows of a next
level, with a sample and prototypes of their own. When a sample covers little besides itself, what is left is dealt to
tables: a bucket holds the rows on the same sides of cuts across further stable projections, and there are as many tables
as let a pair of similarity LEAST miss all of them with probability ``1 - CONFIDENCE``. Levels and lots of tables are staged
one after the other, so no row is sent more than a few times before the disk is free again.

A vector is sent once to its group and once to each group it visits. Copies of a vector are searched
once: their up to k + 1 smallest ids stand for the group in other rows' lists and every copy gets its
own list. Groups are cut into blocks of bounded size by exact counts, and their visitors into bounded
portions, so neither a hot cell nor a popular one is one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sdlweave.runtime import BROADCAST_ROWS, free_shuffles, join_checked, salted_join, stage, unstage

K, LEAST, WIDTH = 10, 0.85, 64
#: Projected dimensions, and the level of the chi-square stopping test.
DIMS, CONFIDENCE = 24, 0.9999
#: Rows of the sample that prototypes are chosen from; similarity within which one covers a sample row or holds a row.
SAMPLE, COVER, HOLD = 16_384, 0.88, 0.86
#: Rows aimed at per group; most rows (on average, by hash) of one block and visitors of one portion.
GROUP_ROWS, BLOCK_ROWS, PORTION = 16_000, 24_000, 48_000
#: Most rows of a leaf of a block's kd-tree, and queries that are searched at a time.
LEAF, QUERIES = 64, 2_048
#: A query to which the stop leaves more than so many leaves open, and more than one in DENSE, verifies all rows of the block
#: at once, so many queries at a time; pairs of a row and a cell that are tested at a time.
MANY, DENSE, AT_ONCE, PAIRS = 32, 8, 64, 200_000
#: Most tables for the rows that samples do not cover, and copies of a row (of all rows) that one lot of tables sends.
TABLES, LOT = 128, 2


def chi2_quantile(p: float, dims: int = DIMS) -> float:
    """Inverse chi-square distribution for an even number of degrees of freedom."""
    cdf = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


REACH = chi2_quantile(CONFIDENCE)
FARTHEST = math.sqrt(2 - 2 * LEAST)
_DIRECTIONS = np.random.default_rng(2718).standard_normal((WIDTH, DIMS))


def usable(vectors: DataFrame, key: str = "stored_id", vector: str = "embedding") -> DataFrame:
    """``vid, vec`` of the rows with a key whose vector has WIDTH finite values that are not all zero."""
    v = F.col(vector)
    ok = (F.size(v) == WIDTH) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(key).cast("long").alias("vid"), v.alias("vec")).filter(ok & F.col("vid").isNotNull())


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows of doubles of unit length."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, WIDTH)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def prototypes(x: np.ndarray) -> np.ndarray:
    """Numbers of rows such that every row is within COVER of one of them, chosen in order."""
    open_rows, chosen = np.ones(len(x), bool), []
    y = x.astype(np.float32)
    for i in range(len(x)):
        if open_rows[i]:
            chosen.append(i)
            open_rows &= (y @ y[i]) < COVER
            open_rows[i] = False
    return np.array(chosen, np.int64)


def kd_groups(points: np.ndarray, weight: np.ndarray, levels: int) -> np.ndarray:
    """The leaf of each point in a complete kd-tree: at each level the widest dimension is cut at the weighted median."""
    leaf = np.zeros(len(points), np.int64)
    for _ in range(levels):
        nxt = leaf * 2
        for n in np.unique(leaf):
            at = np.flatnonzero(leaf == n)
            dim = int(np.argmax(points[at].max(0) - points[at].min(0)))
            order = at[np.argsort(points[at, dim], kind="stable")]
            half = np.searchsorted(np.cumsum(weight[order]), weight[order].sum() / 2)
            nxt[order[half + 1 :]] += 1
        leaf = nxt
    return leaf


def kd_leaves(points: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The rows in leaves of at most LEAF, cut at the median of the widest dimension."""
    out, work = [], [rows]
    while work:
        some = work.pop()
        if len(some) <= LEAF:
            out.append(np.sort(some))
            continue
        x = points[some]
        dim = int(np.argmax(x.max(0) - x.min(0)))
        half = len(some) // 2
        order = np.argpartition(x[:, dim], half)
        work += [some[order[half:]], some[order[:half]]]
    return out


def _holder(protos: np.ndarray):
    """Adds the nearest prototype and whether it holds the row."""
    table = np.ascontiguousarray(protos.T.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1)).astype(np.float32)
                cell, sim = np.zeros(len(x), np.int32), np.zeros(len(x), np.float32)
                for at in range(0, len(x), 512):
                    s = x[at : at + 512] @ table
                    cell[at : at + 512] = s.argmax(1)
                    sim[at : at + 512] = s.max(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell), pa.array(sim >= HOLD)], names=["vid", "vec", "cell", "inner"])

    return run


def _boxer(protos: np.ndarray):
    """Per task one row a cell: inner rows, their largest distance from the prototype and bounds of their projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(protos)
        lo, hi, far, count = np.full((n, DIMS), np.inf), np.full((n, DIMS), -np.inf), np.zeros(n), np.zeros(n, np.int64)
        outer = 0
        for b in batches:
            if b.num_rows:
                inner = b.column(3).to_numpy(zero_copy_only=False)
                outer += int((~inner).sum())
                c, x = b.column(2).to_numpy()[inner], _matrix(b.column(1))[inner]
                p = x @ _DIRECTIONS
                np.minimum.at(lo, c, p)
                np.maximum.at(hi, c, p)
                np.maximum.at(far, c, np.linalg.norm(x - protos[c], axis=1))
                count += np.bincount(c, minlength=n)
        has = np.flatnonzero(count)
        cell = np.append(has, -1).astype(np.int32)  # -1: the outer rows
        lists = [pa.array([*m[has], np.zeros(DIMS)], pa.list_(pa.float64())) for m in (lo, hi)]
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.append(count[has], outer)), pa.array(np.append(far[has], 0.0)), *lists], names=["cell", "n", "far", "lo", "hi"])

    return run


def _balls(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Middle and radius of the balls around the boxes of projections."""
    return (lo + hi) / 2, np.linalg.norm(hi - lo, axis=1) / 2


def _open_balls(p: np.ndarray, middle: np.ndarray, wide: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Which cells the stopping test leaves open to each projection, by the balls around them; ``reach`` is the squared k-th distance."""
    apart = np.sqrt(np.maximum(0, (p**2).sum(1)[:, None] + (middle**2).sum(1)[None] - 2 * p @ middle.T))
    return np.maximum(apart - wide[None] - 1e-9, 0) ** 2 < reach[:, None] * REACH + 1e-9


def _router(centre: np.ndarray, far: np.ndarray, lo: np.ndarray, hi: np.ndarray, group: np.ndarray, group_of: np.ndarray, groups: int):
    """The row itself for its group (the last one for outer rows), and a visitor for each group with an open cell."""
    table = np.ascontiguousarray(centre.T.astype(np.float32))
    # the triangle inequality on similarities, with room for single precision
    nearest = np.cos(np.minimum(2 * np.arcsin(np.minimum((far + FARTHEST) / 2, 1)), np.pi)).astype(np.float32) - np.float32(1e-4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                x, inner = _matrix(b.column(1)), b.column(3).to_numpy(zero_copy_only=False)
                own = np.where(inner, group_of[b.column(2).to_numpy()], groups)
                p = x @ _DIRECTIONS
                r, c = np.nonzero(x.astype(np.float32) @ table >= nearest[None])
                go = np.zeros((b.num_rows, groups + 1), bool)
                for some in range(0, len(r), PAIRS):
                    rs, cs = r[some : some + PAIRS], c[some : some + PAIRS]
                    gap = (np.maximum(np.maximum(lo[cs] - p[rs], p[rs] - hi[cs]), 0) ** 2).sum(1)
                    ok = gap < FARTHEST**2 * REACH
                    go[rs[ok], group[cs[ok]]] = True
                go[np.arange(b.num_rows), own] = False
                row, to = np.nonzero(go)
                row = np.concatenate([np.arange(b.num_rows), row])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([own, to]).astype(np.int32)), pa.array(np.arange(len(row)) >= b.num_rows), *[b.column(i).take(take) for i in range(4)]], names=["grp", "visit", "vid", "vec", "cell", "inner"])

    return run


def _query_router(sample_ids: np.ndarray, sample: np.ndarray, centre: np.ndarray, far: np.ndarray, lo: np.ndarray, hi: np.ndarray, group: np.ndarray, groups: int):
    """A visitor for each group with a cell open to the query, whose first bound is its k-th best in the sample."""
    table, fitted = np.ascontiguousarray(centre.T), np.ascontiguousarray(sample.T)
    middle, wide = _balls(lo, hi)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                ids, x = b.column(0).to_numpy(), _matrix(b.column(1))
                bound = np.full(len(x), -1.0)
                if len(sample) > K:
                    s = x @ fitted
                    s[ids[:, None] == sample_ids[None]] = -2
                    bound = np.maximum(bound, np.partition(s, s.shape[1] - K, axis=1)[:, s.shape[1] - K] - 2e-9)
                reach = np.sqrt(2 - 2 * bound)
                p = x @ _DIRECTIONS
                apart = np.sqrt(np.maximum(0, 2 - 2 * x @ table))
                r, c = np.nonzero(_open_balls(p, middle, wide, reach**2) & (apart <= far[None] + reach[:, None] + 1e-6))
                gap = (np.maximum(np.maximum(lo[c] - p[r], p[r] - hi[c]), 0) ** 2).sum(1)
                ok = gap < reach[r] ** 2 * REACH + 1e-9
                go = np.zeros((b.num_rows, groups + 1), bool)
                go[r[ok], group[c[ok]]] = True
                go[:, groups] = True  # the outer rows have no box
                row, to = np.nonzero(go)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(np.ones(len(row), bool)), *[b.column(i).take(take) for i in range(2)], pa.array(np.zeros(len(row), np.int32)), pa.array(np.ones(len(row), bool)), pa.array(bound[row])], names=["grp", "visit", "vid", "vec", "cell", "inner", "bound"])

    return run


def _column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def _top(owner: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The K best of each owner, by similarity and then id; owners ascend."""
    order = np.lexsort((ids, -sims, owner))
    owner, ids, sims = owner[order], ids[order], sims[order]
    first = np.searchsorted(owner, owner)
    keep = np.arange(len(owner)) - first < K
    return owner[keep], ids[keep], sims[keep]


class Block:
    """The rows of one block in the leaves of a kd-tree over their projections, and the search among them.

    The tree is cut along cells first and below them at the median of the widest projected dimension until no leaf holds
    more than LEAF rows; outer rows have no cells and are cut from the top. A block holds inner rows or outer rows only.
    """

    def __init__(self, t: pa.Table) -> None:
        t = t.sort_by([("cell", "ascending"), ("vid", "ascending")])
        ids, cell, x = _column(t, "vid").to_numpy(), _column(t, "cell").to_numpy(), _matrix(_column(t, "vec"))
        self.outer = bool(len(ids)) and not _column(t, "inner")[0].as_py()
        self.ids, self.x, self.p = ids, x, x @ _DIRECTIONS
        first = np.zeros(min(1, len(ids)), np.int64) if self.outer else np.unique(cell, return_index=True)[1]
        self.leaves = [m for some in np.split(np.arange(len(ids)), first[1:]) for m in kd_leaves(self.p, some)] if len(ids) else []
        self.x32, self.all = x.astype(np.float32), np.arange(len(ids))
        each = lambda f, width: np.array([f(m) for m in self.leaves]).reshape(-1, *width)
        self.lo, self.hi = (each(lambda m, f=f: f(self.p[m], axis=0), (DIMS,)) for f in (np.min, np.max))
        self.mean = each(lambda m: x[m].mean(0), (WIDTH,))
        self.middle = self.mean @ _DIRECTIONS
        self.far = np.array([np.linalg.norm(x[m] - c, axis=1).max() for m, c in zip(self.leaves, self.mean)])
        self.wide = np.array([np.linalg.norm(self.p[m] - c, axis=1).max() for m, c in zip(self.leaves, self.middle)])
        self.tested = self.stopped = self.kept = 0  # query-leaf pairs: looked at, closed by the stop in projection, verified

    def score(self, q: np.ndarray, q_ids: np.ndarray, bound: np.ndarray, pick: np.ndarray, cut: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and similarity from the query's bound on; with ``cut`` at least its K best here."""
        s = q.astype(np.float32) @ (self.x32 if pick is self.all else self.x32[pick]).T
        least = bound - 1e-5
        if cut and s.shape[1] > K + 1:
            over = np.flatnonzero(np.count_nonzero(s >= least[:, None], axis=1) > K + 1)
            if len(over):
                least[over] = np.maximum(least[over], np.partition(s[over], s.shape[1] - K - 1, axis=1)[:, s.shape[1] - K - 1] - 1e-5)
        r, c = np.divmod(np.flatnonzero(s >= least[:, None]), max(1, s.shape[1]))
        c = pick[c]
        other = q_ids[r] != self.ids[c]
        r, c = r[other], c[other]
        sims = np.round(np.einsum("ij,ij->i", q[r], self.x[c]), 9)
        ok = sims >= bound[r]
        return r[ok], c[ok], sims[ok]

    def nearby(self, q: np.ndarray, p: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query, leaf and squared projected distance of the pairs the stop leaves open, each query's nearest leaf first.

        Before them the queries to which balls and triangle inequality leave much of the block open; they have no pairs.

        The stopping test on balls around the leaves' projections, then on their boxes; between them the triangle inequality
        in the full space, which loses nothing.
        """
        reach = 2 - 2 * bound
        apart = np.sqrt(np.maximum(0, (p**2).sum(1)[:, None] + (self.middle**2).sum(1)[None] - 2 * p @ self.middle.T))
        ball = np.maximum(apart - self.wide[None] - 1e-9, 0) ** 2
        going = ball < reach[:, None] * REACH + 1e-9
        self.tested += going.size
        self.stopped += going.size - int(going.sum())
        true = np.sqrt(np.maximum(0, 1 + (self.mean**2).sum(1)[None] - 2 * q @ self.mean.T))
        near = going & (true <= self.far[None] + np.sqrt(reach)[:, None] + 1e-6)
        count = np.count_nonzero(near, axis=1)
        dense = count > max(MANY, len(self.leaves) / DENSE)
        self.kept += int(count[dense].sum())
        near[dense] = False
        r, c = np.nonzero(near)
        gap = np.maximum((np.maximum(np.maximum(self.lo[c] - p[r], p[r] - self.hi[c]), 0) ** 2).sum(1), ball[r, c])
        ok = gap < reach[r] * REACH + 1e-9
        self.stopped += int((~ok).sum())
        r, c, gap = r[ok], c[ok], gap[ok]
        order = np.lexsort((gap, r))
        return np.flatnonzero(dense), r[order], c[order], gap[order]

    def search(self, q: np.ndarray, p: np.ndarray, q_ids: np.ndarray, cut: bool, bound: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Yields query numbers and their hits as (query, row, similarity).

        Incremental: each query takes its leaves in the order of projected distance, one, then two, four and so on; what is
        verified raises the bound on its k-th similarity, and its search ends when the next leaf fails the stopping test.
        Without ``cut`` the bounds stay, as the rows of the block also need the pairs.
        """
        bound = np.full(len(q), LEAST) if bound is None else bound.copy()
        for at in range(0, len(q), QUERIES):
            n = np.arange(at, min(len(q), at + QUERIES))
            dense, r, c, gap = self.nearby(q[n], p[n], bound[n])
            for part in range(0, len(dense), AT_ONCE):
                who = n[dense[part : part + AT_ONCE]]
                yield who, *self.score(q[who], q_ids[who], bound[who], self.all, cut)
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            best = (np.zeros(0, np.int64), np.zeros(0))
            taken = 1
            while len(r):
                now = rank < taken
                self.kept += int(now.sum())
                rows, leaves = r[now], c[now]
                order = np.argsort(leaves, kind="stable")
                rows, leaves = rows[order], leaves[order]
                first = np.flatnonzero(np.diff(leaves, prepend=-1))
                hits = []
                for some, k in zip(np.split(rows, first[1:]), leaves[first]):
                    who = n[some]
                    got = self.score(q[who], q_ids[who], bound[who], self.leaves[k], cut)
                    hits.append((some[got[0]], got[2]))
                    yield who, *got
                if cut:
                    who, s = (np.concatenate([best[i], *(h[i] for h in hits)]) for i in (0, 1))
                    order = np.lexsort((-s, who))
                    who, s = who[order], s[order]
                    place = np.arange(len(who)) - np.searchsorted(who, who)
                    full = place == K - 1
                    bound[n[who[full]]] = np.maximum(bound[n[who[full]]], s[full] - 2e-9)
                    best = who[place < K], s[place < K]
                going = ~now & (gap < (2 - 2 * bound[n[r]]) * REACH + 1e-9)
                self.stopped += int((~now & ~going).sum())
                r, c, gap, rank = r[going], c[going], gap[going], rank[going]
                taken = 2 * taken + 1


def _solve(t: pa.Table) -> pa.Table:
    """Lists of one block's rows (in portion 0) and of one portion of its visitors."""
    visit = _column(t, "visit").to_numpy(zero_copy_only=False)
    block = Block(t.filter(pa.array(~visit)))
    guests = t.filter(pa.array(visit))
    owners, ids, sims = [], [], []

    def take(q_ids: np.ndarray, both: bool, hits: Iterator) -> None:
        for n, r, c, s in hits:
            owners.append(q_ids[n[r]])
            ids.append(block.ids[c])
            sims.append(s)
            if both:
                owners.append(block.ids[c])
                ids.append(q_ids[n[r]])
                sims.append(s)

    if len(block.ids):
        if _column(t, "portion")[0].as_py() == 0:
            take(block.ids, False, block.search(block.x, block.p, block.ids, True))
        for inner in (True, False):  # outer visitors are entered in both lists
            some = guests.filter(pa.array(_column(guests, "inner").to_numpy(zero_copy_only=False) == inner))
            if some.num_rows:
                x, q_ids = _matrix(_column(some, "vec")), _column(some, "vid").to_numpy()
                both = not inner and not block.outer
                take(q_ids, both, block.search(x, x @ _DIRECTIONS, q_ids, not both))
    return _listed(owners, ids, sims)


def _answer(t: pa.Table) -> pa.Table:
    """Lists of the visitors of one block, each from its own bound on."""
    visit = _column(t, "visit").to_numpy(zero_copy_only=False)
    block, guests = Block(t.filter(pa.array(~visit))), t.filter(pa.array(visit))
    owners, ids, sims = [], [], []
    if len(block.ids) and guests.num_rows:
        x, q_ids = _matrix(_column(guests, "vec")), _column(guests, "vid").to_numpy()
        for n, r, c, s in block.search(x, x @ _DIRECTIONS, q_ids, True, _column(guests, "bound").to_numpy()):
            owners.append(q_ids[n[r]])
            ids.append(block.ids[c])
            sims.append(s)
    return _listed(owners, ids, sims)


def _listed(owners: list, ids: list, sims: list) -> pa.Table:
    pairs = [np.concatenate(x) if x else np.zeros(0, k) for x, k in ((owners, np.int64), (ids, np.int64), (sims, np.float64))]
    o, i, s = _top(*pairs)
    who, first = np.unique(o, return_index=True)
    offsets = pa.array(np.append(first, len(o)).astype(np.int32))
    return pa.table({"vid": pa.array(who), "ids": pa.ListArray.from_arrays(offsets, pa.array(i)), "sims": pa.ListArray.from_arrays(offsets, pa.array(s))})


def distinct_vectors(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """One row per distinct vector (smallest id), and staged ``rep, vid`` of the groups of copies, if any."""
    keyed = rows.select("vid", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"))
    heads = keyed.groupBy("h1", "h2").agg(F.min("vid").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    copies = stage(join_checked(keyed, stage(heads), ["h1", "h2"]).select("rep", "vid"))
    if copies.isEmpty():
        return rows, None
    extra = copies.filter("rep <> vid").select("vid")
    small = extra.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(extra) if small else extra, "vid", "left_anti"), copies


def nearest(vectors: DataFrame, key: str = "stored_id", vector: str = "embedding") -> DataFrame:
    """``vid, ids, sims``: the lists of the distinct vectors, by similarity, then id.

    Unusable vectors (null, another width, not finite, all zero) take no part and get no list.
    """
    spark = vectors.sparkSession
    rows, _ = distinct_vectors(usable(vectors, key, vector))
    return _lists(spark, rows, vectors.count())


_SHAPE = "vid long, ids array<long>, sims array<double>"


class Index:
    """Prototypes, cells, groups and blocks of all rows. ``rows`` are distinct vectors, ``sample`` some of them."""

    def __init__(self, rows: DataFrame, sample: pa.Table) -> None:
        self.sample_ids, self.sample = _column(sample, "vid").to_numpy(), _matrix(_column(sample, "vec"))
        protos = self.sample[prototypes(self.sample)]
        self.scored = stage(rows.mapInArrow(_holder(protos), "vid long, vec array<float>, cell int, inner boolean"))
        found = self.scored.mapInArrow(_boxer(protos), "cell int, n long, far double, lo array<double>, hi array<double>")
        per = found.groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far"), *[F.min(F.col("lo")[i]).alias(f"lo{i}") for i in range(DIMS)], *[F.max(F.col("hi")[i]).alias(f"hi{i}") for i in range(DIMS)]).orderBy("cell").toPandas()  # at most a row a prototype
        outer, per = int(per["n"][per["cell"] < 0].sum()), per[per["cell"] >= 0]
        cells, weight = per["cell"].to_numpy(), per["n"].to_numpy().astype(np.float64)
        levels = max(0, round(math.log2(max(1.0, weight.sum() / GROUP_ROWS))))
        self.groups, self.group = 1 << levels, kd_groups(protos[cells] @ _DIRECTIONS, weight, levels) if len(cells) else np.zeros(0, np.int64)
        self.group_of = np.zeros(len(protos), np.int64)
        self.group_of[cells] = self.group
        self.outer = outer
        counts = np.append(np.bincount(self.group, weights=weight, minlength=self.groups), outer).astype(np.int64)
        self.blocks, self.total = np.maximum(1, -(-counts // BLOCK_ROWS)), int(counts.sum())
        self.cells = (protos[cells], per["far"].to_numpy(), per[[f"lo{i}" for i in range(DIMS)]].to_numpy(), per[[f"hi{i}" for i in range(DIMS)]].to_numpy(), self.group)

    def place(self, routed: DataFrame) -> DataFrame:
        """Adds ``block`` and ``portion``: a row lies in its block, for all portions of visitors, and visits the other blocks of its group."""
        if self.blocks.max() == 1 and self.total <= PORTION:
            return routed.withColumns({"block": F.lit(0), "portion": F.lit(0)})
        visitors = routed.filter("visit").groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect() if self.total > PORTION else []  # a row a group
        portions = {r["grp"]: -(-r["n"] // PORTION) for r in visitors}
        sizes = F.broadcast(routed.sparkSession.createDataFrame([(g, int(self.blocks[g]), int(portions.get(g, 1))) for g in range(self.groups + 1)], "grp int, blocks int, portions int"))
        own = F.pmod(F.xxhash64("vid"), F.col("blocks").cast("long")).cast("int")
        share = F.pmod(F.xxhash64("vid", F.lit(3)), F.col("portions").cast("long")).cast("int")
        here = F.transform(F.sequence(F.lit(0), F.col("portions") - 1), lambda p: F.struct(F.lit(False).alias("visit"), own.alias("block"), p.alias("portion")))
        there = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.lit(True).alias("visit"), b.alias("block"), share.alias("portion")))
        only_data = "bound" in routed.columns  # stated queries: rows do not search
        spots = F.when(F.col("visit"), there).otherwise(here if only_data else F.concat(here, F.filter(there, lambda x: x["block"] != own)))
        rest = [c for c in routed.columns if c not in ("grp", "visit")]
        return routed.join(sizes, "grp").withColumn("spot", F.explode(spots)).select("grp", "spot.block", "spot.portion", "spot.visit", *rest)


def _sample(rows: DataFrame, total: int) -> pa.Table:
    """At most SAMPLE rows, those whose hashed ids are smallest; the same at every run.

    ``total`` rows are known, so a cut of the hash range leaves little more than that to the driver and no sort of the
    vectors is needed.
    """
    h = F.shiftrightunsigned(F.xxhash64("vid"), 1)
    some = rows.select("vid", "vec", h.alias("h"))
    if total > SAMPLE:
        some = some.filter(F.col("h") < int(1.2 * SAMPLE / total * 2**63) if 1.2 * SAMPLE < total else F.lit(True))
    return some.toArrow().sort_by([("h", "ascending"), ("vid", "ascending")]).slice(0, SAMPLE)


def _lists(spark, rows: DataFrame, total: int) -> DataFrame:
    parts: list[DataFrame] = []
    whole, before = total, None
    while (sample := _sample(rows, total)).num_rows:
        index = Index(rows, sample)
        if before is not None:
            unstage(before)
        route = _router(*index.cells, index.group_of, index.groups)
        routed = index.scored.mapInArrow(route, "grp int, visit boolean, vid long, vec array<float>, cell int, inner boolean")
        last = index.outer <= BLOCK_ROWS
        if not last:  # outer rows only visit here
            routed = routed.filter(F.col("visit") | (F.col("grp") < index.groups))
        solved = index.place(routed).groupBy("grp", "block", "portion").applyInArrow(_solve, _SHAPE)
        if last:
            parts.append(solved)
            break
        parts.append(stage(_merged(solved)))
        free_shuffles(spark)
        rows, total, before = index.scored.filter("not inner").select("vid", "vec"), index.outer, index.scored
        if index.total - index.outer < 2 * sample.num_rows:
            parts += _from_tables(spark, rows, total, index.sample, max(1, LOT * whole // total))
            break
    return _merged(reduce(DataFrame.unionByName, parts)) if parts else spark.createDataFrame([], _SHAPE)


def tables(n: int, sample: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Directions and cuts of each table for ``n`` rows; buckets of about a third of a block.

    A cut is the sample's median; how likely a pair at the distance FARTHEST is parted there follows from the sample too.
    """
    bits = max(1, math.ceil(math.log2(3 * n / BLOCK_ROWS)))
    some = sample[:: max(1, len(sample) // 512)]
    while True:
        rng, out, missed = np.random.default_rng(3141), [], 1.0
        while missed > 1 - CONFIDENCE and len(out) < TABLES:
            directions = rng.standard_normal((WIDTH, bits))
            cuts = np.median(sample @ directions, axis=0)
            away = np.abs(some @ directions - cuts) / (FARTHEST * math.sqrt(2))
            missed *= 1 - np.prod(1 - np.vectorize(math.erfc)(away).mean(0) / 2)
            out.append((directions, cuts))
        if missed <= 1 - CONFIDENCE or not bits:
            return out
        bits -= 1  # rows too close to each other for so many cuts: larger buckets, nothing left out


def _dealer(first: int, some: list[tuple[np.ndarray, np.ndarray]]):
    """Every row once for each table, in its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, n = _matrix(b.column(1)) if b.num_rows else None, b.num_rows
            for k, (directions, cuts) in enumerate(some if n else []):
                bucket = (x @ directions > cuts) @ (1 << np.arange(len(cuts)))
                flat = [pa.array(np.full(n, first + k, np.int32)), pa.array(bucket.astype(np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, bool))]
                yield pa.RecordBatch.from_arrays([*flat, b.column(0), b.column(1), flat[2], flat[3]], names=["grp", "block", "portion", "visit", "vid", "vec", "cell", "inner"])

    return run


def _from_tables(spark, rows: DataFrame, n: int, sample: np.ndarray, lot: int) -> list[DataFrame]:
    """Staged lists of the rows among themselves, ``lot`` tables at a time."""
    all_tables, out = tables(n, sample), []
    for at in range(0, len(all_tables), lot):
        dealt = rows.mapInArrow(_dealer(at, all_tables[at : at + lot]), "grp int, block int, portion int, visit boolean, vid long, vec array<float>, cell int, inner boolean")
        out.append(stage(_merged(dealt.groupBy("grp", "block", "portion").applyInArrow(_solve, _SHAPE))))
        free_shuffles(spark)
    return out


def _merged(solved: DataFrame) -> DataFrame:
    entries = F.flatten(F.collect_list(F.arrays_zip("ids", "sims")))  # at most K entries a block that was visited
    ranked = F.array_sort(F.array_distinct(F.transform(entries, lambda x: F.struct((-x["sims"]).alias("s"), x["ids"].alias("i")))))
    merged = solved.groupBy("vid").agg(F.slice(ranked, 1, K).alias("l"))
    return merged.select("vid", F.transform("l", lambda x: x["i"]).alias("ids"), F.transform("l", lambda x: -x["s"]).alias("sims"))


def neighbours(vectors: DataFrame, key: str = "stored_id", vector: str = "embedding") -> DataFrame:
    """``vid, other, sim``: up to K neighbours of every usable row, copies included."""
    spark = vectors.sparkSession
    rows, copies = distinct_vectors(usable(vectors, key, vector))
    lists = _lists(spark, rows, vectors.count()).select("vid", F.inline(F.arrays_zip("ids", "sims"))).toDF("vid", "other", "sim")
    if copies is None:
        return lists
    rank = F.row_number().over(Window.partitionBy("vid").orderBy(F.desc("sim"), "other"))  # a key that stands for two vectors has a list of both
    return lists_of_copies(lists, copies).withColumn("rn", rank).filter(F.col("rn") <= K).drop("rn")


def lists_of_copies(lists: DataFrame, copies: DataFrame) -> DataFrame:
    """``vid, other, sim``: the K entries of every row from the lists of the distinct vectors."""
    few = copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    first = copies.withColumn("rn", F.row_number().over(Window.partitionBy("rep").orderBy("vid"))).filter(F.col("rn") <= K + 1).select("rep", F.col("vid").alias("copy"))
    named = first.withColumnRenamed("rep", "other")
    wide = (lists.join(F.broadcast(named), "other", "left") if few else salted_join(stage(lists), named, ["other"], "left")).select("vid", F.coalesce("copy", "other").alias("other"), "sim")
    # a copy's list is that of its vector without itself, so K + 1 entries are enough however many copies there are
    entries = lambda sim, other: F.collect_list(F.struct((-sim).alias("s"), other.alias("i")))
    found = wide.groupBy("vid").agg(entries(F.col("sim"), F.col("other")).alias("found"))  # at most K * (K + 1)
    own = first.groupBy(F.col("rep").alias("vid")).agg(entries(F.lit(1.0), F.col("copy")).alias("own"))
    none = F.array().cast("array<struct<s:double,i:bigint>>")
    tops = found.join(own, "vid", "full").select("vid", F.slice(F.array_sort(F.concat(F.coalesce("found", none), F.coalesce("own", none))), 1, K + 1).alias("l"))
    rows_of = copies.select(F.col("rep").alias("vid"), F.col("vid").alias("row"))
    if few:
        each = tops.join(F.broadcast(rows_of), "vid", "left")
    else:  # a vector with very many copies is spread over tasks, each of which gets its list
        tops = stage(tops)
        single = tops.join(rows_of.select("vid").distinct(), "vid", "left_anti").withColumn("row", F.lit(None).cast("long"))
        each = salted_join(rows_of, tops, ["vid"]).select("vid", "l", "row").unionByName(single)
    each = each.select(F.coalesce("row", "vid").alias("vid"), "l")
    each = each.select("vid", F.inline(F.slice(F.filter("l", lambda x: x["i"] != F.col("vid")), 1, K)))
    return each.select("vid", F.col("i").alias("other"), (-F.col("s")).alias("sim"))


def search(vectors: DataFrame, every: int = 100, key: str = "stored_id", vector: str = "embedding") -> DataFrame:
    """``vid, other, sim``: the K most similar rows to every row whose key is divisible by ``every``, whatever the similarity.

    The queries are stated and few; they visit the rows, which do not search. An outer or distant query has a
    far k-th neighbour and so visits much.
    """
    spark = vectors.sparkSession
    everyone = usable(vectors, key, vector)
    rows, copies = distinct_vectors(everyone)
    sample = _sample(rows, vectors.count())
    if not sample.num_rows:
        return spark.createDataFrame([], "vid long, other long, sim double")
    index = Index(rows, sample)
    shape = "grp int, visit boolean, vid long, vec array<float>, cell int, inner boolean, bound double"
    group = F.element_at(F.lit([int(g) for g in index.group_of]), F.col("cell") + 1)
    data = index.scored.select(F.when(F.col("inner"), group).otherwise(index.groups).cast("int").alias("grp"), F.lit(False).alias("visit"), "vid", "vec", "cell", "inner", F.lit(0.0).alias("bound"))
    queries = everyone.filter(F.col("vid") % every == 0).mapInArrow(_query_router(index.sample_ids, index.sample, *index.cells, index.groups), shape)
    lists = _merged(index.place(data.unionByName(queries)).groupBy("grp", "block", "portion").applyInArrow(_answer, _SHAPE))
    flat = lists.select("vid", F.inline(F.arrays_zip("ids", "sims"))).toDF("vid", "other", "sim")
    if copies is None:
        return flat
    first = copies.withColumn("rn", F.row_number().over(Window.partitionBy("rep").orderBy("vid"))).filter(F.col("rn") <= K + 1).select("rep", F.col("vid").alias("copy"))
    wide = salted_join(flat, first.withColumnRenamed("rep", "other"), ["other"], "left").select("vid", F.coalesce("copy", "other").alias("other"), "sim")
    own = first.filter(F.col("rep") % every == 0).select(F.col("rep").alias("vid"), F.col("copy").alias("other"), F.lit(1.0).alias("sim"))
    rank = F.row_number().over(Window.partitionBy("vid").orderBy(F.desc("sim"), "other"))
    return wide.union(own).filter("vid <> other").withColumn("rn", rank).filter(F.col("rn") <= K).drop("rn")


def neighbour_pairs(vectors: DataFrame) -> DataFrame:
    """``stored_id_a, stored_id_b``, smaller first, once: either is a neighbour of the other."""
    n = neighbours(vectors)
    return n.select(F.least("vid", "other").alias("stored_id_a"), F.greatest("vid", "other").alias("stored_id_b")).distinct()
