"""Near-duplicate records (problem 1) by covering locality-sensitive hashing.

A record is the set of its words, a bit vector over all words. Sets of sizes a and b with a Jaccard
similarity of at least 4/5 differ in at most (a + b) / 9 words, so the question is a Hamming radius k.
Sizes fall into bands so wide that similar sets lie in the same band or the next; a set enters the
group of its own band and the one below, and k is fixed per group.

Within a group, words are dealt by hash to parts whose radii r satisfy sum(r + 1) = k + 1; two sets
within k then differ by at most r words in some part. In a part, each word has a non-zero label of r + 1
bits and there is a table for each non-zero mask v of r + 1 bits, which keeps the words whose label has
an odd number of bits in common with v. Any r labels leave a mask orthogonal to all of them, so some
table keeps none of the differing words: **every** pair within the radius collides in some table. The key
of a table is a hash of the kept words. Colliding pairs pass a parity sketch (a lower bound of the
difference, so nothing is lost) and then the exact test.

Equal sets are one class first: one representative enters the tables, however many copies there are.
Table keys shared by very many different sets (found by a frequent-items sketch, which combines on the map
side) are salted: a set lies in one block of its key and is compared from there with all blocks, so the pairs
of a hot key are spread over as many tasks as it has blocks. No pair is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sdlweave.operators.components import components
from sdlweave.runtime import MAX_HOT_KEYS, salted_join, stage

TYPES = ("object", "interface", "input", "enum")
MIN_WORDS = 12
#: Largest radius of one part; 2 ** (RADIUS + 1) - 1 tables a part.
RADIUS = 2
#: Sets that share a table key from which it is salted, sets of one block, keys that the sketch reports.
HOT_ROWS, BLOCK_ROWS, HOT_KEYS = 20_000, 4_000, 1_000
#: Copies from which a class is hot.
HOT_COPIES = 20_000
_LABELS = 1 << (RADIUS + 1)
_SKETCH_BITS, _SIZE_CAP = 52, 4095


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser; wraps around."""
    x = x + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bands(largest: int) -> list[tuple[int, int]]:
    """Size bands ``(low, high)`` from MIN_WORDS on that reach ``largest``."""
    out, lo = [], MIN_WORDS
    while True:
        hi = lo * 5 // 4
        out.append((lo, hi))
        if hi >= largest:
            return out
        lo = hi + 1


def radius(high: int) -> int:
    """Most differences between similar sets of which the smaller has at most ``high`` words."""
    return (high + high * 5 // 4) // 9


_M = np.array([[bin(m & v).count("1") & 1 for v in range(_LABELS)] for m in range(_LABELS)], dtype=np.uint64)


def signatures(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table keys of all sets and the set each belongs to. ``words`` holds the sets one after another."""
    if not len(sizes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    table = bands(int(sizes.max()))
    low = np.array([b[0] for b in table])
    k_of = np.array([radius(b[1]) for b in table])
    band = np.searchsorted(low, sizes, side="right") - 1
    keys, owners = [], []
    owner_of_word = np.repeat(np.arange(len(sizes)), sizes)
    for role in (0, 1):  # the group of the own band, and of the band below
        group = band - role
        use = group >= 0
        k1 = np.where(use, k_of[np.maximum(group, 0)] + 1, 0)  # sum of r + 1 over the parts
        parts = -(-k1 // (RADIUS + 1))
        last = np.where(k1 > 0, k1 - (np.maximum(parts, 1) - 1) * (RADIUS + 1), 0)  # r + 1 of the last part
        base = np.concatenate([[0], np.cumsum(parts)])
        pick = use[owner_of_word]
        w, o = words[pick], owner_of_word[pick]
        part = (_mix(w, 0x9E3779B97F4A7C15) % parts[o].astype(np.uint64)).astype(np.int64)
        bits = np.where(part == parts[o] - 1, last[o], RADIUS + 1)
        label = (1 + _mix(w, 0x1F83D9ABFB41BD6B) % ((1 << bits) - 1).astype(np.uint64)).astype(np.int64)
        cells = np.zeros(int(base[-1]) * _LABELS, np.uint64)
        np.add.at(cells, (base[o] + part) * _LABELS + label, _mix(w, 0x5BE0CD19137E2179))
        kept = cells.reshape(-1, _LABELS) @ _M
        owner = np.repeat(np.arange(len(sizes)), parts)
        number = np.arange(len(owner)) - base[owner]
        width = np.where(number == parts[owner] - 1, last[owner], RADIUS + 1)
        for v in range(1, _LABELS):
            has = v < (1 << width)
            where = (group[owner[has]].astype(np.uint64) << np.uint64(40)) | (number[has].astype(np.uint64) << np.uint64(8)) | np.uint64(v)
            keys.append(_mix(kept[has, v] ^ _mix(where, 0x243F6A8885A308D3), 0x13198A2E03707344))
            owners.append(owner[has])
    return np.concatenate(keys), np.concatenate(owners)


def sketches(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per set: 52 parity bits of its words, and its size (at most 4095) above them."""
    bits = np.uint64(1) << (_mix(words, 0x452821E638D01377) % np.uint64(_SKETCH_BITS))
    x = np.bitwise_xor.reduceat(bits, starts) if len(sizes) else np.zeros(0, np.uint64)
    return x | (np.minimum(sizes, _SIZE_CAP).astype(np.uint64) << np.uint64(_SKETCH_BITS))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            b = whole.slice(at, 1000)
            ids, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            words = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            keys, owner = signatures(words, starts, sizes)
            sk = sketches(words, starts, sizes).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids[owner]), pa.array(sk[owner])], names=["sig", "rep", "sk"])


def word_sets(docs: DataFrame) -> DataFrame:
    """``row_id, words, h1, h2`` of the rows considered; ``words`` are sorted 64-bit hashes.

    Rows with null key or content or too few words take no part.
    """
    hashed = F.transform(F.regexp_extract_all("content", F.lit("[A-Za-z0-9_]+"), F.lit(0)), lambda w: F.xxhash64(F.lower(w)))
    sets = docs.filter(F.col("type").isin(*TYPES) & F.col("row_id").isNotNull()).select("row_id", F.array_sort(F.array_distinct(hashed)).alias("words")).filter(F.size("words") >= MIN_WORDS)
    return sets.select("row_id", "words", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), "words").alias("h2"))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged ``rep, words, n`` of the distinct sets, and ``rep, row_id`` of all rows."""
    base = stage(word_sets(docs))
    heads = base.groupBy("h1", "h2").agg(F.min("row_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    keyed = base.select("row_id", "h1", "h2")
    hot = heads.filter(F.col("n") >= HOT_COPIES).orderBy(F.desc("n"), "rep").limit(MAX_HOT_KEYS).select("h1", "h2")
    heads, hot = stage(heads), stage(hot)
    found = keyed.join(heads, ["h1", "h2"]) if hot.isEmpty() else salted_join(keyed, heads, ["h1", "h2"], hot=hot)
    member = stage(found.select("rep", "row_id", "n"))
    reps = base.join(member.filter("rep = row_id").select("row_id", "n"), "row_id").select(F.col("row_id").alias("rep"), "words", "n")
    return reps, member


def _spread(signed: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the self-join with ``blk``: 0, or for hot keys the own block and every block."""
    hot = []
    if reps.count() >= HOT_ROWS:  # fewer sets cannot make a hot key
        sketch = signed.agg(F.expr(f"approx_top_k(sig, {HOT_KEYS}, {10 * HOT_KEYS})").alias("t"))
        hot = [(r["item"], -(-r["count"] // BLOCK_ROWS)) for r in sketch.select(F.inline("t")).collect() if r["count"] >= HOT_ROWS]  # at most HOT_KEYS rows
    if not hot:
        plain = signed.withColumn("blk", F.lit(0))
        return plain, plain
    marked = signed.join(F.broadcast(signed.sparkSession.createDataFrame(hot, "sig long, blocks long")), "sig", "left")
    own = marked.withColumn("blk", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("rep"), F.col("blocks"))).cast("int"))
    every = marked.withColumn("blk", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))))
    return own.drop("blocks"), every.drop("blocks")


def links(reps: DataFrame) -> DataFrame:
    """Staged ``a, b`` (a < b): all pairs of distinct sets with similarity at least 4/5."""
    signed = reps.select("rep", "words").repartition("rep").mapInArrow(_sign, "sig long, rep long, sk long")
    mask = (1 << _SKETCH_BITS) - 1
    x, y = (d.alias(n) for d, n in zip(_spread(signed, reps), "xy"))
    size = lambda s: F.shiftrightunsigned(F.col(f"{s}.sk"), _SKETCH_BITS)
    near = (F.bit_count(F.col("x.sk").bitwiseXOR(F.col("y.sk")).bitwiseAND(F.lit(mask))) * 9 <= size("x") + size("y")) & (F.least(size("x"), size("y")) * 5 >= F.greatest(size("x"), size("y")) * 4)
    pairs = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.blk") == F.col("y.blk")) & (F.col("x.rep") < F.col("y.rep")) & near).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    words = reps.select("rep", "words")
    both = pairs.join(words.select(F.col("rep").alias("a"), F.col("words").alias("wa")), "a").join(words.select(F.col("rep").alias("b"), F.col("words").alias("wb")), "b")
    common = F.size(F.array_intersect("wa", "wb"))
    return stage(both.filter(common * 5 >= (F.size("wa") + F.size("wb") - common) * 4).select("a", "b"))


def _hot_classes(member: DataFrame) -> DataFrame | None:
    """``rep`` of the classes with very many copies, if there are any; the largest MAX_HOT_KEYS of them."""
    hot = member.filter((F.col("rep") == F.col("row_id")) & (F.col("n") >= HOT_COPIES)).orderBy(F.desc("n"), "rep").limit(MAX_HOT_KEYS).select("rep")
    return None if hot.isEmpty() else stage(hot)


def _expanded(copies: DataFrame, other: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """Join on ``key``; the copies of a hot class are spread over tasks, each of which gets the class's rows of ``other``."""
    return copies.join(other, key) if hot is None else salted_join(copies, other, [key], hot=hot.toDF(key))


def similar_pairs(docs: DataFrame) -> DataFrame:
    """``row_id_a, row_id_b``, smaller first: all similar pairs of rows, copies expanded."""
    reps, member = classes(docs)
    found, hot = links(reps), _hot_classes(member)
    half = _expanded(member.select(F.col("rep").alias("a"), F.col("row_id").alias("ra")), found, "a", hot).select("b", "ra")
    across = _expanded(member.select(F.col("rep").alias("b"), F.col("row_id").alias("rb")), half, "b", hot).select("ra", "rb")
    copies = member.filter("n > 1")
    within = _expanded(copies.select("rep", F.col("row_id").alias("ra")), copies.select("rep", F.col("row_id").alias("rb")), "rep", hot).filter("ra < rb").select("ra", "rb")
    return across.union(within).select(F.least("ra", "rb").alias("row_id_a"), F.greatest("ra", "rb").alias("row_id_b"))


def groups(docs: DataFrame) -> DataFrame:
    """``row_id, class_id, group_id, n_links``: a row per document considered.

    ``class_id`` is the smallest row with the same words, ``group_id`` the smallest row of the connected
    component, ``n_links`` the number of other classes the row's class is similar to.
    """
    reps, member = classes(docs)
    found = links(reps)
    labels = components(found)
    both = found.select("a").union(found.select("b"))
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("n_links"))
    known = labels.join(degree, labels["node"] == degree["a"]).select(F.col("node").alias("rep"), "component", "n_links")
    return member.join(known, "rep", "left").select("row_id", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
