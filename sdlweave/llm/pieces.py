"""Splitting oversized items at natural boundaries (problem 4).

A type's content is scanned once into a header (through the brace that opens the body) and members. The
gaps between members are the natural boundaries. Lexical cohesion is measured at each gap: the cosine of
the word counts of the members before and after it; the depth of the valley there is how far the
cohesion rises on both sides. Each piece ends at the deepest valley within a size window below the limit
and the next piece starts with the last member of the piece before (the overlap).

``fill`` is the lower edge of that window as a share of the limit. ``p4_found`` fixes that a piece takes
as many members as fit, which is the window with a single gap in it, ``fill = 1``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sdlweave.runtime import spread

LIMIT = 2000
TYPES = ("object", "interface", "input", "enum")
#: Members on each side of a gap that are compared; characters that plain pieces share.
SIDE, PLAIN_OVERLAP = 3, 100
_TOKEN = re.compile(r'(?P<skip>[\s,﻿]+|#[^\r\n]*)|(?P<str>"""(?:\\"""|(?!""").)*"""|"(?:\\.|[^"\\\r\n])*")|(?P<name>[A-Za-z_]\w*)|(?P<num>-?\d[\w.+-]*)|(?P<punct>\.\.\.|[!$&()\[\]{}:=@|])|(?P<other>.)', re.S | re.A)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, set(")]}")


def tokens(text: str) -> list[tuple[str, str, int, int]]:
    """``kind, text, start, end`` of all tokens but ignored ones."""
    return [(m.lastgroup, m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text) if m.lastgroup != "skip"]


def members(text: str) -> tuple[int, list[tuple[int, int]]] | None:
    """End of the header, and start and end of each member; None if the text is no type with a body."""
    ts = tokens(text)
    depth, at = 0, None
    for i, (_, t, _, _) in enumerate(ts):
        if t == "{" and depth == 0:
            at = i
            break
        if t in "([{" and t in _OPEN:
            depth += 1
        elif t in _CLOSE:
            depth -= 1
    if at is None:
        return None
    header, out, i = ts[at][3], [], at + 1

    def group(i: int) -> int:
        """Index after the bracketed group that opens at i."""
        d = 0
        while i < len(ts):
            if ts[i][1] in _OPEN and ts[i][0] == "punct":
                d += 1
            elif ts[i][1] in _CLOSE and ts[i][0] == "punct":
                d -= 1
                if d == 0:
                    return i + 1
            i += 1
        raise ValueError

    def value(i: int) -> int:
        if ts[i][1] in ("[", "{"):
            return group(i)
        return i + 2 if ts[i][1] == "$" else i + 1

    try:
        while ts[i][1] != "}":
            start = ts[i][2]
            if ts[i][0] == "str":
                i += 1
            if ts[i][0] != "name":
                return None
            i += 1
            if ts[i][1] == "(":
                i = group(i)
            if ts[i][1] == ":":
                i += 1
                i = group(i) if ts[i][1] == "[" else i + 1
                while ts[i][1] == "!":
                    i += 1
            if ts[i][1] == "=":
                i = value(i + 1)
            while ts[i][1] == "@":
                i += 2
                if ts[i][1] == "(":
                    i = group(i)
            out.append((start, ts[i - 1][3]))
    except (IndexError, ValueError):
        return None
    return (header, out) if out else None


_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def valleys(parts: list[str]) -> list[float]:
    """Depth of the cohesion valley at each gap between neighbouring parts."""
    counts = [Counter(w.lower() for w in _WORD.findall(p)) for p in parts]
    cohesion = []
    for g in range(1, len(parts)):
        a, b = sum(counts[max(0, g - SIDE) : g], Counter()), sum(counts[g : g + SIDE], Counter())
        norm = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
        cohesion.append(sum(x * b[w] for w, x in a.items()) / norm if norm else 0.0)
    # the height climbed on each side before the cohesion falls again
    left, right = list(cohesion), list(cohesion)
    for g in range(1, len(cohesion)):
        left[g] = left[g - 1] if cohesion[g - 1] >= cohesion[g] else cohesion[g]
    for g in range(len(cohesion) - 2, -1, -1):
        right[g] = right[g + 1] if cohesion[g + 1] >= cohesion[g] else cohesion[g]
    return [a - c + b - c for a, b, c in zip(left, right, cohesion)]


def pack(header: int, spans: list[tuple[int, int]], limit: int, fill: float, depth: list[float]) -> list[tuple[int, int]] | None:
    """First and last member of each piece; None if a member does not fit with header and ``}`` alone.

    A piece ends at the deepest valley among the gaps at which it has at least ``fill`` of the limit, or at the
    last gap that fits if none has. With ``fill`` 1 that is always the last one: as many members as fit.
    """
    size = lambda a, b: header + spans[b][1] - spans[a][0] + 1
    if any(size(m, m) > limit for m in range(len(spans))):
        return None
    out, first, n = [], 0, len(spans)
    while True:
        last = first
        while last + 1 < n and size(first, last + 1) <= limit:
            last += 1
        if last < n - 1:
            # after a first piece a gap behind the first member, so that the overlap leaves progress
            window = [m for m in range(first + (1 if out else 0), last + 1) if size(first, m) >= fill * limit] or [last]
            last = max(window, key=lambda m: (depth[m], m))
        out.append((first, last))
        if last == n - 1:
            return out
        first = last if size(last, last + 1) <= limit else last + 1


def greedy(text: str, limit: int = LIMIT) -> list[tuple[int, int]]:
    """The pieces of ``p4_found``; none if the text does not scan or a member does not fit."""
    scanned = members(text)
    if not scanned:
        return []
    header, spans = scanned
    return pack(header, spans, limit, 1.0, valleys([text[a:b] for a, b in spans])) or []


def _plain(text: str, limit: int, overlap: int) -> list[str]:
    """Pieces of text without members: cut after the last sentence end, white space or sign in the window."""
    out, at = [], 0
    while len(text) - at > limit:
        end = at + limit
        for pattern in (r"[.!?\n](?=\s|$)", r"\s", r"[^\w\s]"):
            found = [m.end() for m in re.finditer(pattern, text[at + limit // 2 : end])]
            if found:
                end = at + limit // 2 + found[-1]
                break
        out.append(text[at:end])
        at = max(at + 1, end - overlap)
    return [*out, text[at:]]


def split(text: str, limit: int = LIMIT, fill: float = 0.5) -> list[tuple[int, int, str]]:
    """``first_member, last_member, piece`` by cohesion valleys, for any text; members -1 where there are none.

    A member too large for a piece is cut as plain text, each part with header and ``}``. A header that
    leaves no room makes the whole text plain.
    """
    if len(text) <= limit:
        return [(-1, -1, text)]
    scanned = members(text)
    if not scanned or scanned[0] + 1 > limit // 2:
        return [(-1, -1, p) for p in _plain(text, limit, PLAIN_OVERLAP)]
    header, spans = scanned
    head, out, run = text[:header], [], []

    def flush() -> None:
        if run:
            depth = valleys([text[a:b] for a, b in run_spans()])
            for a, b in pack(header, run_spans(), limit, fill, depth) or []:
                out.append((run[a], run[b], head + text[spans[run[a]][0] : spans[run[b]][1]] + "}"))
            run.clear()

    run_spans = lambda: [spans[m] for m in run]
    for m, (a, b) in enumerate(spans):
        if header + b - a + 1 > limit:
            flush()
            room = limit - header - 1
            out += [(m, m, head + p + "}") for p in _plain(text[a:b], room, min(PLAIN_OVERLAP, room // 4))]
        else:
            run.append(m)
    flush()
    return out


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, n, first, last) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n, (first, last) in enumerate(greedy(text))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[k] for r in rows], pa.int32()) for k in (1, 2, 3)]], names=["row_id", "piece_no", "first_member", "last_member"])


def oversized(docs: DataFrame, types: tuple[str, ...] | None, limit: int = LIMIT) -> DataFrame:
    """``row_id, content`` of the rows over the limit that are not chunks; spread evenly, as they cluster."""
    long = docs.filter((F.length("content") > limit) & F.col("metadata.chunkIndex").isNull())
    if types:
        long = long.filter(F.col("type").isin(*types))
    return spread(long.select("row_id", "content"))


def found_pieces(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``row_id, piece_no, first_member, last_member``. Null contents and rows that do not scan give none."""
    return oversized(docs, TYPES, limit).mapInArrow(_found, "row_id long, piece_no int, first_member int, last_member int")


def pieces(docs: DataFrame, limit: int = LIMIT, fill: float = 0.5) -> DataFrame:
    """``row_id, chunkIndex, totalChunks, first_member, last_member, piece`` of every oversized row, whatever its type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = split(text, limit, fill)
                rows += [(i, n, len(got), *p) for n, p in enumerate(got)]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            names = ["row_id", "chunkIndex", "totalChunks", "first_member", "last_member", "piece"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return oversized(docs, None, limit).mapInArrow(run, "row_id long, chunkIndex int, totalChunks int, first_member int, last_member int, piece string")


def checks(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Per oversized row: its characters, and whether all pieces keep the limit, are numbered without gaps and hold every member.

    A hole between the members of consecutive pieces, or a first piece that does not begin at member 0, is a lost member.
    """
    got = pieces(docs, limit).withColumn("after", F.lag("last_member").over(Window.partitionBy("row_id").orderBy("chunkIndex")))
    held = F.when(F.col("after").isNull(), F.col("first_member") <= 0).otherwise(F.col("first_member") <= F.col("after") + 1)
    per = got.groupBy("row_id").agg(F.bool_and(F.length("piece") <= limit).alias("within_limit"), (F.count_distinct("chunkIndex") == F.max("totalChunks")).alias("numbered"), F.bool_and(held).alias("members_held"))
    return oversized(docs, None, limit).select("row_id", F.length("content").alias("n_chars")).join(per, "row_id", "left")
