"""Registered queries of the schema text operators over all of ``embedding_documents.content``.

Every row's text is read, whatever its type and however often it repeats. A row of type field holds
``Parent.name(arguments): Type`` behind its description; it is read as that field standing in its parent, and
what the wrapping adds is left out of the results. Lines and columns are those of the text as read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sdlweave.operators import designs as D
from sdlweave.operators import federation, lint
from sdlweave.operators.validation import validate_operations, validate_schema
from sdlweave.runtime import spread, stage, table
from sdlweave.sdl.documents import arrow_schema, chunk_documents, parse_documents, rows_to_batch, syntax_errors
from sdlweave.sdl.lexer import SyntaxProblem
from sdlweave.sdl.parser import ROOTS

#: Characters of a chunk, as in problem 4.
LIMIT = 2000
_FIELD = re.compile(r'(\s*(?:"""(?:\\"""|(?!""").)*"""|"(?:\\.|[^"\\\n])*")?\s*)([_A-Za-z]\w*)\s*\.\s*(?=[_A-Za-z])', re.S)
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def standing(content: str | None, type: str | None, kind: str | None = None) -> str | None:
    """The text of a row as schema text; a field's text that does not begin as one is returned as it is."""
    m = _FIELD.match(content) if content and type == "field" else None
    if not m:
        return content
    return f"{'input' if kind == 'InputValueDefinition' else 'type'} {m[2]}{{{m[1]}{content[m.end() :]}}}"


def texts(docs: DataFrame) -> DataFrame:
    """``src`` (``row_id, collection, type``) and ``sdl`` of each row."""
    shape = "src struct<row_id: bigint, collection: string, type: string>, sdl string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_pylist([{"src": {k: r[k] for k in ("row_id", "collection", "type")}, "sdl": standing(r["content"], r["type"], r["kind"])} for r in rows], schema=schema)

    schema = arrow_schema(T.StructType.fromDDL(shape))
    return spread(docs.select("row_id", "collection", "type", "content", F.col("metadata.kind").alias("kind"))).mapInArrow(run, shape)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return texts(table(spark, d, "embedding_documents"))


def parsed(sources: DataFrame) -> DataFrame:
    """Document rows of each text; of a wrapped field only the field."""
    got = parse_documents(sources, keep="src")
    return got.filter("src.type is distinct from 'field' or type = 'field'").withColumn("row_id", F.col("src.row_id"))


def _maybe_root(sources: DataFrame) -> DataFrame:
    """Without the field rows whose text names no root: these need not be parsed for root fields."""
    return sources.filter(F.expr("src.type is distinct from 'field'") | F.col("sdl").rlike("|".join(ROOTS)))


@query
def content_types(spark: SparkSession, d: str) -> DataFrame:
    docs = parsed(_texts(spark, d).filter("src.type is distinct from 'field'")).filter("type <> 'field'")  # a wrapped field gives no type
    return docs.select("row_id", "ordinal", "id", "type", "name", "description", "content", F.coalesce(F.size("metadata.fields"), F.lit(-1)).alias("n_fields"))


@query
def content_root_fields(spark: SparkSession, d: str) -> DataFrame:
    docs = parsed(_maybe_root(_texts(spark, d))).filter("metadata.isRootOperationField")
    return docs.select("row_id", "ordinal", "id", "name", "content", F.col("metadata.parentType").alias("parent"), F.col("metadata.fieldType").alias("field_type"), F.col("metadata.rootOperationType").alias("root"))


@query
def content_syntax_errors(spark: SparkSession, d: str) -> DataFrame:
    return syntax_errors(_texts(spark, d), keep="src").select("src.row_id", "message", "line", "column")


@query
def content_chunks(spark: SparkSession, d: str) -> DataFrame:
    """All rows; a text within the limit, without members or unreadable is one chunk."""
    docs = spread(table(spark, d, "embedding_documents").select("row_id", "id", "type", "content", "metadata", "source_id"))
    return chunk_documents(docs, LIMIT).select("row_id", "id", "source_id", "content", F.col("metadata.chunkIndex").alias("chunk_index"), F.col("metadata.totalChunks").alias("total_chunks"))


def nodes(sources: DataFrame) -> DataFrame:
    got = lint.nodes(sources, keep="src").filter("src.type is distinct from 'field' or kind in ('FieldDefinition', 'InputValueDefinition')")
    return got.select("src.row_id", F.coalesce("src.collection", F.lit("\x00")).alias("collection"), *[n for n, _ in lint.NODE_FIELDS])


def linted(sources: DataFrame) -> DataFrame:
    """Violations of each text; the usage of an enum is looked up in all texts of its collection."""
    return lint.lint(stage(nodes(sources)), keep="row_id", within="collection")  # read three times


@query
def content_lint(spark: SparkSession, d: str) -> DataFrame:
    return linted(_texts(spark, d))


@query
def content_outline(spark: SparkSession, d: str) -> DataFrame:
    """The outline of each collection; a definition that many rows repeat counts once, in order of its first row."""
    once = nodes(_texts(spark, d)).groupBy("collection", "kind", "parent", "name").agg(F.min(F.struct("row_id", "ordinal")).alias("ordinal"))
    return lint.outline(once, keep="collection").withColumn("collection", F.when(F.col("collection") != "\x00", F.col("collection")))


@query
def content_located(spark: SparkSession, d: str) -> DataFrame:
    """Every field named by the rows of type field, in each text of its parent in the same collection."""
    docs = table(spark, d, "embedding_documents")
    asked = docs.filter("type = 'field' and name is not null").select("collection", F.trim("metadata.parentType").alias("p"), F.concat_ws(".", F.trim("metadata.parentType"), "name").alias("target")).filter("p <> ''").distinct()
    held = docs.filter("type in ('object', 'interface', 'input')").select("row_id", "collection", F.col("name").alias("p"), "content")
    got = asked.join(held, ["collection", "p"]).select("row_id", "target", D.locate_column(F.col("content"), F.col("target")).alias("at"))
    return got.filter("at is not null").select("row_id", "target", "at.line", "at.column", "at.end_column")


@query
def content_api_schema(spark: SparkSession, d: str) -> DataFrame:
    """Each readable text without federation's parts."""
    def rows(sdl: str) -> list[dict]:
        return [{"api": federation.api_schema(sdl)}]

    return federation.table_function(_texts(spark, d), rows, [T.StructField("api", T.StringType())], keep="src").select("src.row_id", "api")


def schemas(sources: DataFrame, docs: DataFrame) -> DataFrame:
    """``collection, sdl, operations``: the schema text of each collection and an operation for each root field.

    Of each type and each root field the latest readable text that is no chunk is taken (``content_syntax_errors``
    lists the others). A collection is one row by definition.
    """
    ok = parsed(_maybe_root(sources)).select("row_id", "type", "name", "content", F.col("metadata.rootOperationType").alias("root"), F.col("src.type").alias("row_type"))
    ok = ok.filter("root is not null or type <> 'field' and row_type <> 'field'")
    when = docs.filter("metadata.chunkIndex is null").select("row_id", "collection", "loaded_at")
    latest = Window.partitionBy("collection", "root", "name").orderBy(F.desc("loaded_at"), F.desc("row_id"))
    best = ok.join(when, "row_id").withColumn("n", F.row_number().over(latest)).filter("n = 1")
    got = best.groupBy("collection").agg(F.array_sort(F.collect_list(F.struct("root", "name", "content"))).alias("parts"))
    shape = "collection string, sdl string, operations array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                text = [p["content"] for p in r["parts"] if p["root"] is None]
                for root in ROOTS:
                    own = [standing(p["content"], "field") for p in r["parts"] if p["root"] == root]
                    text += own[:1] + [f"extend {x}" for x in own[1:]]
                asked = [f"{p['root'].lower()} {{ {p['name']} }}" for p in r["parts"] if p["root"] is not None]
                out.append({"collection": r["collection"], "sdl": "\n".join(text), "operations": asked})
            yield rows_to_batch(out, schema)

    schema = arrow_schema(T.StructType.fromDDL(shape))
    return got.mapInArrow(run, shape)


def _schemas(spark: SparkSession, d: str) -> DataFrame:
    return schemas(_texts(spark, d), table(spark, d, "embedding_documents"))


@query
def content_schema_checks(spark: SparkSession, d: str) -> DataFrame:
    return schema_errors(_schemas(spark, d))


def schema_errors(sources: DataFrame) -> DataFrame:
    shape = "collection string, message string, line int, column int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield rows_to_batch([{"collection": r["collection"], **e} for e in validate_schema(r["sdl"])], schema)

    schema = arrow_schema(T.StructType.fromDDL(shape))
    return sources.select("collection", "sdl").mapInArrow(run, shape)


@query
def content_operation_checks(spark: SparkSession, d: str) -> DataFrame:
    """An operation for each root field, without arguments and selections, against its collection's schema; null if valid."""
    shape = "collection string, operation string, message string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                got = zip(r["operations"], validate_operations(r["operations"], r["sdl"]))
                yield rows_to_batch([{"collection": r["collection"], "operation": o, "message": m} for o, ms in got for m in ms or [None]], schema)

    schema = arrow_schema(T.StructType.fromDDL(shape))
    return _schemas(spark, d).mapInArrow(run, shape)
