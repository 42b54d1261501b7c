"""Nested JSON records to related flat tables (problem 3).

Each payload is read once by an event parser, in Arrow batches, into path-value-ordinal triples. A path is
kept as its *repeated ancestor* (the keys from the top up to the last list, ``[]`` for each list) and the
*step* below it; ``ordinals`` holds the position in each of those lists, ``value`` the scalar as text. Triples
with one repeated ancestor belong to one table, which is pivoted from them by its ordinals; these are also
the foreign keys: a parent's key is a prefix of its children's.

The parser keeps no tree and does not recurse: what is open is a stack, so any depth can be read, and numbers are
their text, so any length can. Paths and ordinals are links to their parents until a batch is written. A query
names the paths it wants; others are read past without a trace.

A payload that is null or not a readable JSON object gives no triples, which is known only at its end, so the
triples of one payload wait for it. Of a repeated key the last value counts. Rows that repeat key and payload count
once; a key with several payloads gives the rows of each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sdlweave.runtime import stage

ITEM_LISTS = ("arguments", "enumValues", "possibleTypes", "interfaces", "fields")
_DOC = "design.subgraphs[].documents[]"
_ARG = f"{_DOC}.metadata.arguments[]"
#: Places where a list is expected; a single value there stands for a list of one.
LIST_PATHS = frozenset({"design.subgraphs", "design.subgraphs[].documents", *(f"{_DOC}.metadata.{x}" for x in ITEM_LISTS)})
#: Places where a value may arrive as JSON text.
TEXT_PATHS = frozenset({f"{_DOC}.metadata"})
TRIPLES = "batch_id long, source long, ancestor string, step string, ordinals array<int>, value string, kind string"
#: Rows and characters of one batch of triples; nodes of the path tree before it is begun anew.
BATCH_ROWS, BATCH_CHARS, NODES = 50_000, 16 << 20, 200_000
#: Most columns of a table that is pivoted, and most such tables; what exceeds them stays in the long form.
COLUMNS, TABLES = 500, 200

#: One step of the reading: a comma, then a string (a key with its colon), a bracket, a number or a constant.
_TOKEN = re.compile(
    r'[ \t\n\r]*(,)?[ \t\n\r]*(?:'
    r'"([^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*)"(?:[ \t\n\r]*(:))?'
    r"|([{}\[\]])"
    r"|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"
    r"|(true|false|null))"
)
_STRING, _COLON, _SIGN, _NUMBER = 2, 3, 4, 5
_END = re.compile(r"[ \t\n\r]*\Z")


def events(text: str) -> Iterator[tuple[str, str | None]]:
    """``kind, value`` in document order: ``{ } [ ]``, key, string, number (as written), bool and null.

    Raises ValueError where the text stops being JSON.
    """
    at, match, closers = 0, _TOKEN.match, []
    first, due = True, True  # nothing stands in the open container yet; a value must come, at the top or after a key
    while due or closers:
        m = match(text, at)
        if m is None:
            raise ValueError(f"not JSON at {at}")
        at, group, comma = m.end(), m.lastindex, m[1] is not None
        sign = m[4] if group == _SIGN else None
        if not due:
            if sign is not None and sign == closers[-1]:
                if comma:
                    raise ValueError(f"comma before the end at {at}")
                first = False
                yield closers.pop(), None
                continue
            if comma == first:
                raise ValueError(f"comma at {at}")
            first = False
            if closers[-1] == "}":
                if group != _COLON:
                    raise ValueError(f"key expected at {at}")
                due = True
                s = m[2]
                yield "key", json.loads(f'"{s}"') if "\\" in s else s
                continue
        elif comma:
            raise ValueError(f"comma at {at}")
        due = False
        if group == _STRING:
            s = m[2]
            yield "string", json.loads(f'"{s}"') if "\\" in s else s
        elif group == _SIGN and (sign == "{" or sign == "["):
            closers.append("}" if sign == "{" else "]")
            first = True
            yield sign, None
        elif group == _NUMBER:
            yield "number", m[5]
        elif group > _NUMBER:
            yield ("null", None) if m[6] == "null" else ("bool", m[6])
        else:
            raise ValueError(f"value expected at {at}")
    if not _END.match(text, at):
        raise ValueError(f"text after the value at {at}")


class Paths:
    """A tree of path steps; a list step is None. With wanted paths, any step but theirs and those ``below`` leads to node -1."""

    def __init__(self, wanted: Iterable[str] | None = None, below: Iterable[str] = ()) -> None:
        self.up: list[int] = [-1]
        self.step: list[str | None] = [""]
        self.kids: dict[tuple[int, str | None], int] = {}
        self._text: dict[int, tuple[str, str]] = {}
        self.closed, self.inside = False, set()
        self.lists, self.texts = ({self._insert(p) for p in some} for some in (LIST_PATHS, TEXT_PATHS))
        self.keep = None if wanted is None else {self._insert(p) for p in wanted}
        self.inside = {self._insert(p) for p in below}
        self.closed = wanted is not None

    def _insert(self, path: str) -> int:
        node = 0
        for s in re.findall(r"\[\]|[^.\[\]]+", path):
            node = self.go(node, None if s == "[]" else s)
        return node

    def go(self, node: int, key: str | None) -> int:
        got = self.kids.get((node, key))
        if got is not None:
            return got
        if node < 0 or self.closed and node not in self.inside:
            return -1
        self.up.append(node)
        self.step.append(key)
        self.kids[node, key] = len(self.up) - 1
        if node in self.inside:
            self.inside.add(len(self.up) - 1)
        return len(self.up) - 1

    def text(self, node: int) -> tuple[str, str]:
        """Repeated ancestor and the step below it; the path's own signs are escaped in keys."""
        got = self._text.get(node)
        if got is None:
            steps, n = [], node
            while n > 0:
                steps.append(self.step[n])
                n = self.up[n]
            steps.reverse()
            last = max((i for i, s in enumerate(steps) if s is None), default=-1) + 1
            got = _written(steps[:last]), _written(steps[last:])
            if len(got[0]) + len(got[1]) < 1000:  # long ones are not kept
                self._text[node] = got
        return got


def _written(steps: list[str | None]) -> str:
    return "".join("[]" if s is None else f".{_key(s)}" for s in steps)[1:]


def _key(k: str) -> str:
    return k.replace("\\", "\\\\").replace(".", "\\.").replace("[]", "\\[]") if "." in k or "[" in k or "\\" in k else k


def _read(text: str, paths: Paths, node: int, link: tuple | None, out: list, nested: bool = False) -> None:
    """Append ``node, link, value, kind`` of each scalar, list item and empty container; ``link`` chains the ordinals."""
    frames: list[list] = []  # node, link, items so far, pending key, where it began in out, what each key wrote
    key: str | None = None
    top = True
    for kind, value in events(text):
        if kind == "key":
            f = frames[-1]
            if f[0] >= 0:
                if f[2]:
                    f[5][f[3]] = (f[4], len(out))
                f[3], f[4] = value, len(out)
                if value in f[5]:  # the last of repeated keys counts
                    a, b = f[5][value]
                    out[a:b] = [None] * (b - a)
            f[2] += 1
            key = value
            continue
        if kind in "}]":
            f = frames.pop()
            if not f[2] and f[0] >= 0 and (kind == "]" or f[0] and paths.step[f[0]] is not None):
                out.append((f[0], f[1], None, "object" if kind == "}" else "list"))
            continue
        if top:
            n, at, top = node, link, False
        elif frames[-1][5] is None:
            f = frames[-1]
            n, at = paths.go(f[0], None), (f[1], f[2])
            f[2] += 1
        else:
            n, at = paths.go(frames[-1][0], key), frames[-1][1]
        if n in paths.texts and kind == "string" and not nested:
            mark = len(out)
            try:
                _read(value, paths, n, at, out, True)
                continue
            except ValueError:
                del out[mark:]
        if n in paths.lists and kind not in ("[", "null"):
            n, at = paths.go(n, None), (at, 0)
        if kind == "{" or kind == "[":
            if kind == "{" and n >= 0 and (not n or paths.step[n] is None):
                out.append((n, at, None, "object"))
            frames.append([n, at, 0, None, 0, {} if kind == "{" else None])
        elif n >= 0:
            out.append((n, at, value, kind))


def triples_of(payload: str | None, paths: Paths | None = None) -> Iterator[tuple[str, str, list[int], str | None, str]]:
    """``ancestor, step, ordinals, value, kind`` of one payload in document order; none if it is not a readable JSON object.

    The top and objects in lists give a triple of kind ``object``, as do empty ones; empty lists one of kind ``list``.
    """
    paths = paths or Paths()
    out: list = []
    if payload is None or not payload.lstrip(" \t\n\r").startswith("{"):
        return
    try:
        _read(payload, paths, 0, None, out)
    except ValueError:
        return
    for t in out:
        if t is None or paths.keep is not None and t[0] not in paths.keep and t[0] not in paths.inside:
            continue
        node, link, value, kind = t
        at: list[int] = []
        while link:
            link, i = link
            at.append(i)
        yield *paths.text(node), at[::-1], value, kind


_SCHEMA = pa.schema([("batch_id", pa.int64()), ("source", pa.int64()), ("ancestor", pa.string()), ("step", pa.string()), ("ordinals", pa.list_(pa.int32())), ("value", pa.string()), ("kind", pa.string())])


def _sound(s: str | None) -> str | None:
    return s if s is None or s.isascii() else s.encode("utf-8", "replace").decode()


def _shredder(wanted: list[str] | None, below: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, rows, chars = Paths(wanted, below), [], 0
        for b in batches:
            for key, source, payload in zip(*(b.column(i).to_pylist() for i in range(3))):
                if len(paths.up) > NODES:
                    paths = Paths(wanted, below)
                for ancestor, step, at, v, kind in triples_of(payload, paths):
                    rows.append((key, source, _sound(ancestor), _sound(step), at, _sound(v), kind))
                    chars += len(ancestor) + len(step) + 4 * len(at) + len(v or "")
                    if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)
                        rows, chars = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    return run


def triples(raw: DataFrame, wanted: Iterable[str] | None = None, below: Iterable[str] = (), key: str = "batch_id", payload: str = "payload") -> DataFrame:
    """Path-value-ordinal triples of all payloads, of all paths or of the wanted ones and those below ``below``.

    ``source`` tells payloads with the same key apart.
    """
    rows = raw.select(F.col(key).cast("long").alias("batch_id"), F.xxhash64(key, payload).alias("source"), F.col(payload).alias("payload"))
    return rows.mapInArrow(_shredder(None if wanted is None else list(wanted), list(below)), TRIPLES)


def pivot_group(t: DataFrame, ancestors: dict[str, str], columns: dict[str, str], keys: list[str], label: str | None = None) -> DataFrame:
    """Rows of the repeated ``ancestors`` (to their names in the column ``label``), a column for each of ``columns``.

    ``columns`` maps names to steps below the ancestor, '' being the item itself; ``keys`` name the ordinals, outermost
    first. ``_kind`` is the item's own kind. One map-side aggregation by record and ordinals.
    """
    picked = [F.max(F.when(F.col("step") == s, F.col("value"))).alias(n) for n, s in columns.items()]
    got = t.filter(F.col("ancestor").isin(*ancestors) & (F.size("ordinals") == len(keys))).groupBy("batch_id", "source", "ancestor", "ordinals").agg(*picked, F.max(F.when(F.col("step") == "", F.col("kind"))).alias("_kind"))
    names = F.create_map(*[F.lit(x) for kv in ancestors.items() for x in kv])
    return got.select("batch_id", *([names[F.col("ancestor")].alias(label)] if label else []), *[F.col("ordinals")[i].alias(k) for i, k in enumerate(keys)], *columns, "_kind")


def _table(raw: DataFrame, ancestors: dict[str, str], columns: dict[str, str], keys: list[str], label: str | None = None) -> DataFrame:
    """The same from the payloads, of which only these paths leave the parser."""
    wanted = [*ancestors, *(f"{a}.{s}" if a else s for a in ancestors for s in columns.values() if s)]
    return pivot_group(triples(raw, wanted), ancestors, columns, keys, label)


def batches_table(raw: DataFrame) -> DataFrame:
    """A row per readable payload."""
    cols = {"collection": "collection", "config_path": "design.config_path", "federation_version": "design.federation_version"}
    return _table(raw, {"": ""}, cols, []).drop("_kind")


def subgraphs_table(raw: DataFrame) -> DataFrame:
    return _table(raw, {"design.subgraphs[]": ""}, {"name": "name", "routing_url": "routing_url"}, ["subgraph_pos"]).filter(F.col("_kind") == "object").drop("_kind")


def documents_table(raw: DataFrame) -> DataFrame:
    cols = {c: c for c in ("id", "type", "name", "description")} | {"parent_type": "metadata.parentType", "field_type": "metadata.fieldType", "kind": "metadata.kind"}
    return _table(raw, {_DOC: ""}, cols, ["subgraph_pos", "doc_pos"]).filter(F.col("_kind") == "object").drop("_kind")


def list_items(raw: DataFrame) -> DataFrame:
    """``batch_id, subgraph_pos, doc_pos, list_name, item_pos, item`` of the five lists.

    ``item`` is the string itself or, for an object, its name ('' if absent or null). Nulls keep their
    position but give no row.
    """
    paths = {f"{_DOC}.metadata.{x}[]": x for x in ITEM_LISTS}
    got = _table(raw, paths, {"own": "", "name": "name"}, ["subgraph_pos", "doc_pos", "item_pos"], "list_name")
    item = F.when(F.col("_kind") == "object", F.coalesce("name", F.lit(""))).otherwise(F.col("own"))
    return got.filter(~F.col("_kind").isin("null", "list")).select("batch_id", "subgraph_pos", "doc_pos", "list_name", "item_pos", item.alias("item"))


def arguments_table(raw: DataFrame) -> DataFrame:
    """A row per argument with its own columns; a scalar in place of an object is its name. Nulls give no row.

    A type given as an object has its outermost kind and name here and all of it in :func:`argument_properties`.
    """
    cols = {"own": "", "name": "name", "type": "type", "type_kind": "type.kind", "type_name": "type.name", "description": "description"}
    got = _table(raw, {_ARG: ""}, cols, ["subgraph_pos", "doc_pos", "arg_pos"]).filter(~F.col("_kind").isin("null", "list"))
    return got.withColumn("name", F.coalesce("name", "own")).drop("own", "_kind")


def argument_properties(raw: DataFrame) -> DataFrame:
    """``…, arg_pos, property, value``: everything below an argument outside further lists, whatever its name."""
    rows = triples(raw, [], [_ARG]).filter((F.col("ancestor") == _ARG) & (F.col("step") != "") & ~F.col("kind").isin("object", "list"))
    return rows.select("batch_id", *[F.col("ordinals")[i].alias(k) for i, k in enumerate(("subgraph_pos", "doc_pos", "arg_pos"))], F.col("step").alias("property"), "value", "kind").distinct()


def directives_table(raw: DataFrame) -> DataFrame:
    """The directives of arguments, children of :func:`arguments_table`."""
    return _table(raw, {f"{_ARG}.directives[]": ""}, {"name": "name"}, ["subgraph_pos", "doc_pos", "arg_pos", "directive_pos"]).filter(F.col("_kind") == "object").drop("_kind")


def directive_arguments(raw: DataFrame) -> DataFrame:
    """The arguments of directives, children of :func:`directives_table`."""
    keys = ["subgraph_pos", "doc_pos", "arg_pos", "directive_pos", "value_pos"]
    return _table(raw, {f"{_ARG}.directives[].args[]": ""}, {"name": "name", "value": "value"}, keys).filter(F.col("_kind") == "object").drop("_kind")


def groups(t: DataFrame) -> DataFrame:
    """``ancestor, step, kind, n``: the paths that occur, by repeated ancestor."""
    return t.groupBy("ancestor", "step", "kind").agg(F.count(F.lit(1)).alias("n"))


def tables(raw: DataFrame, columns: int = COLUMNS, most: int = TABLES) -> dict[str, DataFrame]:
    """A table for every repeated ancestor that occurs, by its path, with a column for every step below it.

    ``batch_id`` and ``pos_1, pos_2, …`` are the keys. Groups with more than ``columns`` steps (keys that are data), and those
    beyond the ``most`` largest, are not pivoted: their triples are the table ``*``, so nothing is lost.
    """
    t = stage(triples(raw))
    found = groups(t).filter("step <> ''").groupBy("ancestor").agg(F.count_distinct("step").alias("k"), F.sum("n").alias("n"))
    plain = groups(t).groupBy("ancestor").agg(F.sum("n").alias("m")).join(found, "ancestor", "left").filter(F.coalesce("k", F.lit(0)) <= columns)
    chosen = [r["ancestor"] for r in plain.orderBy(F.desc("m"), "ancestor").limit(most).select("ancestor").collect()]  # at most `most` rows
    steps: dict[str, set[str]] = {a: set() for a in chosen}
    for r in t.filter(F.col("ancestor").isin(*chosen) & (F.col("step") != "") & ~F.col("kind").isin("object", "list")).select("ancestor", "step").distinct().toLocalIterator():  # at most `columns` a table
        steps[r["ancestor"]].add(r["step"])
    out = {}
    for a in chosen:
        depth = a.count("[]") - a.count("\\[]")
        names = {f"c{i}": s for i, s in enumerate(sorted(steps[a]))}
        got = pivot_group(t, {a: ""}, {"c": "", **names}, [f"pos_{i + 1}" for i in range(depth)])
        out[a] = got.toDF(*["value" if c == "c" else names.get(c, c) for c in got.columns])
    return {**out, "*": t.filter(~F.col("ancestor").isin(*chosen))}
