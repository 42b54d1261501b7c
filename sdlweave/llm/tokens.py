"""Encoding of a corpus with a public byte-level tokenizer (problem 7).

Texts up to ``CHUNK`` characters are encoded where they lie. Longer ones are cut into overlapping chunks
that are spread over the cluster. Each chunk is pre-tokenised from its own start; in the overlap the
two streams of pre-tokens resynchronise at the first boundary that both have, and from there on they
agree, since a pre-token depends only on the text to its right. A chunk gives its ids up to that point,
and how many of its own first ids lie before the point found by the chunk before it; stitching drops those.
The overlap is chosen to contain a change from a non-space to a space, where every stream has a boundary
whatever it takes for a letter or a number, so a text is only cut where its streams must meet; where none
follows soon, the chunk goes on. White space is that of the pattern, Unicode's White_Space: the separators
U+001C to U+001F are none. Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sdlweave.runtime import spread, stage

VOCABULARY = os.environ.get("SDLWEAVE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The pre-token pattern of the vocabulary, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a chunk, least overlap, and how far ahead a place to cut is looked for.
CHUNK, OVERLAP, AHEAD = 32_768, 64, 8_192
#: White space as the pattern has it: Unicode's White_Space, fixed values. ``str.isspace`` has four more.
SPACES = frozenset("\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_MEET = re.compile(f"[^{''.join(sorted(SPACES))}](?=[{''.join(sorted(SPACES))}])")
_encoders: dict = {}


def encoder(path: str = VOCABULARY):
    """The encoding, loaded once in each worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def encode(text: str, path: str = VOCABULARY) -> np.ndarray:
    return encoder(path).encode_to_numpy(text, disallowed_special=()).astype(np.int32) if text else np.zeros(0, np.int32)


def decode(ids, path: str = VOCABULARY) -> bytes:
    return encoder(path).decode_bytes(list(ids))


def cuts(text: str, chunk: int = CHUNK, ahead: int = AHEAD) -> list[tuple[int, int]]:
    """Start of each chunk and end of its overlap with the next one."""
    starts, ends, at = [0], [], chunk
    while at < len(text):
        meet = _MEET.search(text, at + OVERLAP, at + ahead)
        if meet is None:
            at += chunk
            continue
        starts.append(at)
        ends.append(meet.end() + 1)
        at += chunk
    return list(zip(starts, [*ends, len(text)]))


_boundaries = regex.compile(PATTERN)


def _meets(text: str, p: int) -> bool:
    """Whether a non-space changes to a space at ``p``: a boundary of every stream."""
    return text[p] in SPACES and text[p - 1] not in SPACES


def encode_chunk(text: str, head: int, tail: int, path: str = VOCABULARY) -> tuple[list[int], list[int], int, np.ndarray]:
    """Encode one chunk; ``head`` is the length of the overlap at its start, ``tail`` where the one at its end begins.

    Returns the boundaries within the head, the number of ids before each, the meeting point after ``tail``
    (-1 without one) and the ids up to it.
    """
    end = len(text)
    meet = -1
    if tail < end:
        # the stream of the next chunk, and where this one's passes through it
        other = {m.end() + tail for m in _boundaries.finditer(text[tail:])}
        own = (m.end() for m in _boundaries.finditer(text, _restart(text, tail)))
        end = meet = next(p for p in own if tail < p < end and p in other and _meets(text, p))
    marks, counts, ids, at = [], [], [], 0
    if head:
        total = 0
        for m in _boundaries.finditer(text[:end]):
            p = m.end()
            if p > head:
                break
            if p < len(text) and _meets(text, p):
                ids.append(encode(text[at:p], path))
                total += len(ids[-1])
                marks.append(p)
                counts.append(total)
                at = p
    ids.append(encode(text[at:end], path))
    return marks, counts, meet - tail if meet >= 0 else -1, np.concatenate(ids)


def _restart(text: str, tail: int) -> int:
    """A boundary of every stream at or before ``tail``: the last change from a non-space to a space, or 0."""
    return next((p for p in range(tail, 0, -1) if _meets(text, p)), 0)


def _lists(parts: list[np.ndarray], kind=None) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))


def _whole(count: bool, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                ids = [encode(t, path) if t else np.zeros(0, np.int32) for t in b.column(1).to_pylist()]
                out = pa.array([len(i) for i in ids], pa.int32()) if count else _lists(ids)
                yield pa.RecordBatch.from_arrays([b.column(0), out], names=["doc_id", "n" if count else "ids"])

    return run


def _cut(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, row, text in zip(*(b.column(c).to_pylist() for c in range(3))):
                places = cuts(text, chunk)
                for n, (start, end) in enumerate(places):
                    head = places[n - 1][1] - start if n else 0
                    tail = places[n + 1][0] - start if n + 1 < len(places) else end - start
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([row], pa.int64()), pa.array([n], pa.int32()), pa.array([head], pa.int32()), pa.array([tail], pa.int32()), pa.array([text[start:end]], pa.string())], names=["doc_id", "row", "chunk_no", "head", "tail", "text"])

    return run


def _encode_chunks(count: bool, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                key, row, n, head, tail, text = (b.column(c)[i].as_py() for c in range(6))
                marks, counts, meet, ids = encode_chunk(text, head, tail, path)
                last = pa.array([len(ids)], pa.int32()) if count else pa.array([ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([row], pa.int64()), pa.array([n], pa.int32()), pa.array([marks], pa.list_(pa.int32())), pa.array([counts], pa.list_(pa.int32())), pa.array([meet], pa.int32()), last], names=["doc_id", "row", "chunk_no", "marks", "counts", "meet", "out"])

    return run


def _encoded(docs: DataFrame, count: bool, key: str, text: str, path: str, chunk: int) -> DataFrame:
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    out, kind = ("n", "int") if count else ("ids", "array<int>")
    short = spread(rows.filter(F.col("text").isNull() | (F.length("text") <= chunk))).mapInArrow(_whole(count, path), f"doc_id long, {out} {kind}")
    # a number of their own keeps the chunks of rows with equal or null keys apart
    cut = rows.filter(F.length("text") > chunk).select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    long = cut.mapInArrow(_cut(chunk), "doc_id long, row long, chunk_no int, head int, tail int, text string").repartition("row", "chunk_no")
    parts = long.mapInArrow(_encode_chunks(count, path), f"doc_id long, row long, chunk_no int, marks array<int>, counts array<int>, meet int, out {kind}")
    before = F.lag("meet").over(Window.partitionBy("row").orderBy("chunk_no"))
    drop = F.coalesce(F.element_at("counts", F.array_position("marks", F.col("before")).cast("int")), F.lit(0))
    met = parts.withColumn("before", before).withColumn("drop", F.when(F.col("before").isNull() | (F.col("before") == 0), 0).otherwise(drop))
    if count:
        stitched = met.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum(F.col("out") - F.col("drop")).cast("int").alias(out)).drop("row")
    else:
        kept = met.select("doc_id", "row", "chunk_no", F.expr("slice(out, drop + 1, size(out))").alias("out"))
        ordered = F.array_sort(F.collect_list(F.struct("chunk_no", "out")))  # one text
        stitched = kept.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.flatten(F.transform(ordered, lambda x: x["out"])).alias(out)).drop("row")
    return short.unionByName(stitched)


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, ids``: the ids of each text without special tokens; empty and null texts give an empty list."""
    return _encoded(docs, False, key, text, path, chunk)


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n``: the number of ids of each text, without the ids leaving the worker."""
    return _encoded(docs, True, key, text, path, chunk)


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [md5(decode(i or [], path)).hexdigest() for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], names=["doc_id", "decoded"])

    return run


def checks(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``check_name, n``: documents with ids, those with an empty list, and those whose ids do not decode to the bytes of their text."""
    ids = stage(token_ids(docs, path=path))
    back = ids.mapInArrow(_decoded(path), "doc_id long, decoded string")
    wrong = docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("own")).join(back, "doc_id").filter("own <> decoded")
    some = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check_name"), "n")
    return some("documents", ids).union(some("empty", ids.filter(F.size("ids") == 0))).union(some("not_decoded", wrong))
