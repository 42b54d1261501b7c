"""Schema text to document rows, and document rows to chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sdlweave.sdl.lexer import SyntaxProblem, compact, tokens
from sdlweave.sdl.parser import ROOTS, Node, parse

ARGUMENT = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "type", "description")])
_strings = T.ArrayType(T.StringType())
METADATA = T.StructType(
    [
        T.StructField("parentType", T.StringType()),
        T.StructField("fieldType", T.StringType()),
        T.StructField("arguments", T.ArrayType(ARGUMENT)),
        *[T.StructField(n, _strings) for n in ("enumValues", "possibleTypes", "interfaces", "fields")],
        T.StructField("isRootOperationField", T.BooleanType()),
        T.StructField("rootOperationType", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("chunkIndex", T.IntegerType()),
        T.StructField("totalChunks", T.IntegerType()),
    ]
)
DOCUMENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "type", "name", "description", "content")]
    + [T.StructField("metadata", METADATA), T.StructField("source_id", T.StringType()), T.StructField("ordinal", T.IntegerType())]
)
_KINDS = {"ObjectTypeDefinition": "object", "InputObjectTypeDefinition": "input", "InterfaceTypeDefinition": "interface", "EnumTypeDefinition": "enum", "UnionTypeDefinition": "union", "ScalarTypeDefinition": "scalar"}
_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def content_id(text: str) -> str:
    """The 32-bit string hash over UTF-16 units, its absolute value in base 36."""
    h = 0
    units = text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(units), 2):
        h = (31 * h + units[i] + (units[i + 1] << 8)) & 0xFFFFFFFF
    h = abs(h - (1 << 32) if h >> 31 else h)
    out = ""
    while True:
        h, r = divmod(h, 36)
        out = _DIGITS[r] + out
        if not h:
            return out


def _arguments(node: Node) -> list[dict]:
    return [{"name": a.name, "type": a.type, "description": a.description} for a in node.args]


def documents(sdl: str) -> list[dict]:
    """Document rows in order of definition; extensions, directives and ``schema`` give none.

    Root operation types give only their fields. Raises :class:`SyntaxProblem` on unreadable text.
    """
    text = compact(sdl)
    out: list[dict] = []

    def add(kind: str, node: Node, content: str, **metadata) -> None:
        key = content_id(content)
        out.append({"id": key, "type": kind, "name": node.name, "description": node.description, "content": content, "metadata": {"kind": node.kind, **metadata}, "source_id": key, "ordinal": len(out)})

    for d in parse(text):
        if d.kind not in _KINDS:
            continue
        kind, content = _KINDS[d.kind], text[d.start : d.end]
        names = [x.name for x in d.items]
        root = kind == "object" and d.name in ROOTS
        if kind == "object" and not root:
            add(kind, d, content, interfaces=d.names, fields=names)
        elif kind in ("input", "interface"):
            add(kind, d, content, fields=names)
        elif kind == "enum":
            add(kind, d, content, enumValues=names)
        elif kind == "union":
            add(kind, d, content, possibleTypes=d.names)
        elif kind == "scalar":
            add(kind, d, content)
        if kind in ("object", "input", "interface"):
            for f in d.items:
                more = {"parentType": d.name, "fieldType": f.type}
                if kind != "input":
                    more["arguments"] = _arguments(f)
                if root:
                    more |= {"isRootOperationField": True, "rootOperationType": d.name}
                add("field", f, f"{text[f.start : f.at]}{d.name}.{text[f.at : f.end]}", **more)
    return out


def members(content: str) -> tuple[str, list[str]] | None:
    """Header through the body's brace, and the members with the space that joins them; None without a body."""
    try:
        (node,) = parse(content)
        ts = tokens(content)
    except (SyntaxProblem, ValueError):
        return None
    if not node.items:
        return None
    brace = max(t.start for t in ts if t.text == "{" and t.kind == "punct" and t.start < node.items[0].start)
    ends = [m.start for m in node.items[1:]] + [node.items[-1].end]
    return content[: brace + 1], [content[m.start : e] for m, e in zip(node.items, ends)]


def chunk(doc: dict, limit: int) -> list[dict]:
    """A document as chunks under ``limit`` characters, cut between members.

    Types with fields and enums are cut; others, and texts that fit or do not parse, stay whole. A chunk
    holds at least one member, so a single long member may exceed the limit.
    """
    if len(doc["content"]) <= limit or doc["type"] not in ("object", "interface", "input", "enum"):
        return [doc]
    split = members(doc["content"])
    if split is None:
        return [doc]
    header, parts = split
    groups: list[list[str]] = [[]]
    size = len(header) + 1
    for p in parts:
        if groups[-1] and size + len(p) > limit:
            groups.append([])
            size = len(header) + 1
        groups[-1].append(p)
        size += len(p)
    if len(groups) == 1:
        return [doc]
    out = []
    for i, g in enumerate(groups):
        content = header + "".join(g) + "}"
        out.append({**doc, "id": content_id(content), "content": content, "metadata": {**(doc["metadata"] or {}), "chunkIndex": i, "totalChunks": len(groups)}})
    return out


def arrow_schema(spark_type: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark_type)


def rows_to_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def parse_documents(sources: DataFrame, sdl: str = "sdl", keep: str = "path") -> DataFrame:
    """Table function over ``sources``: the document rows of each text, with the column ``keep``.

    Unreadable, blank and null texts give no rows; :func:`syntax_errors` reports them.
    """
    shape = T.StructType([T.StructField(keep, sources.schema[keep].dataType), *DOCUMENT.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(shape)
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += [{keep: key, **d} for d in documents(text)] if text and text.strip() else []
                except SyntaxProblem:
                    continue
            yield rows_to_batch(rows, schema)

    return sources.select(keep, sdl).mapInArrow(run, shape)


def syntax_errors(sources: DataFrame, sdl: str = "sdl", keep: str = "path") -> DataFrame:
    """``keep, message, line, column`` of each text that does not parse."""
    shape = T.StructType([T.StructField(keep, sources.schema[keep].dataType), T.StructField("message", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(shape)
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    parse(text or "")
                except SyntaxProblem as e:
                    rows.append({keep: key, "message": e.message, "line": e.line, "column": e.column})
            yield rows_to_batch(rows, schema)

    return sources.select(keep, sdl).mapInArrow(run, shape)


def chunk_documents(docs: DataFrame, limit: int | None = None, limit_column: str | None = None) -> DataFrame:
    """Chunks of document rows; extra columns pass through. The limit is fixed or read from a column.

    ``source_id`` keeps the id from before chunking.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d in b.to_pylist():
                most = limit if limit_column is None else d[limit_column]
                d = {**d, "source_id": d.get("source_id") or d["id"]}
                rows += chunk(d, most) if d["content"] is not None and most is not None else [d]
            yield rows_to_batch(rows, schema)

    named = docs if "source_id" in docs.columns else docs.withColumn("source_id", F.col("id"))
    schema = arrow_schema(named.schema)
    return named.mapInArrow(run, named.schema)
