"""The schema text operators over whole tables."""

import duckdb
import pytest

import __spark_entry__
from sdlweave.plans import contents as C
from sdlweave.sdl.documents import chunk, documents
from sdlweave.sdl.lexer import SyntaxProblem


def test_standing():
    assert C.standing('"""a. "b" """Query.order(id:ID!):Order', "field") == 'type Query{"""a. "b" """order(id:ID!):Order}'
    assert C.standing('"x \\" Y.z"In.a:Int=1', "field", "InputValueDefinition") == 'input In{"x \\" Y.z"a:Int=1}'
    assert C.standing("?", "field") == "?" and C.standing(None, "field") is None and C.standing("type A{a:Int}", "object") == "type A{a:Int}"


@pytest.fixture(scope="module")
def held(data):
    return duckdb.sql(f"select row_id, id, type, content, metadata, source_id from read_parquet('{data}/embedding_documents.parquet')").to_arrow_table().to_pylist()


def brute(held, of):
    rows, bad = [], set()
    for r in held:
        try:
            rows += [(r["row_id"], x) for x in of(C.standing(r["content"], r["type"], (r["metadata"] or {}).get("kind")) or "") if r["type"] != "field" or x["type"] == "field"]
        except SyntaxProblem:
            bad.add(r["row_id"])
    return rows, bad


def test_every_row_is_read(spark, data, held):
    run = lambda name: __spark_entry__.queries()[name](spark, data).collect()
    rows, bad = brute(held, documents)
    assert sorted((r.row_id, r.ordinal, r.id, r.name) for r in run("content_types")) == sorted((k, x["ordinal"], x["id"], x["name"]) for k, x in rows if x["type"] != "field")
    assert sorted((r.row_id, r.ordinal, r.id, r.root) for r in run("content_root_fields")) == sorted((k, x["ordinal"], x["id"], x["metadata"]["rootOperationType"]) for k, x in rows if x["metadata"].get("isRootOperationField"))
    assert {r.row_id for r in run("content_syntax_errors")} == bad
    cut = [(r["row_id"], c["content"]) for r in held for c in (chunk(r, C.LIMIT) if r["content"] is not None else [r])]
    assert sorted((r.row_id, r.content) for r in run("content_chunks")) == sorted(cut)
    for name in C.QUERIES:
        assert name in __spark_entry__.queries()
    for name in ("content_lint", "content_outline", "content_located", "content_api_schema", "content_schema_checks", "content_operation_checks"):
        assert run(name), name


def sources(spark, rows):
    return C.texts(spark.createDataFrame([(i, c, t, x, (None,)) for i, c, t, x in rows], "row_id long, collection string, type string, content string, metadata struct<kind: string>"))


def test_lint_uses_the_collection(spark):
    """The enum and the argument that uses it stand in different rows; the wrapper of a field is not linted."""
    src = sources(spark, [(1, "x", "enum", "enum State{A}"), (2, "x", "field", "OddType.find(state:State):Int"), (3, "y", "enum", "enum State{A}"), (4, None, "enum", "enum Mode{A}"), (5, None, "field", "Q.a(m:Mode):Int")])
    assert sorted((r.row_id, r.rule) for r in C.linted(src).collect()) == [(1, "ENUM_USED_AS_INPUT_WITHOUT_SUFFIX"), (4, "ENUM_USED_AS_INPUT_WITHOUT_SUFFIX")]


def test_schema_of_a_collection(spark):
    rows = [(1, "object", "x", "type A{a:Int}"), (2, "object", "x", "type A{b:B}"), (3, "object", "x", "type A{"), (4, "field", "x", "Query.one(id:ID!):A"), (5, "field", "x", "Query.two:Int"), (6, "object", None, "type N{a:Int}")]
    table = spark.createDataFrame([(i, t, c, x, (None, None)) for i, t, c, x in rows], "row_id long, type string, collection string, content string, metadata struct<kind: string, chunkIndex: int>").selectExpr("*", "timestamp_seconds(row_id) as loaded_at")
    got = C.schemas(C.texts(table), table)
    assert {r.collection: (r.sdl, r.operations) for r in got.collect()} == {"x": ("type A{b:B}\ntype Query{one(id:ID!):A}\nextend type Query{two:Int}", ["query { one }", "query { two }"]), None: ("type N{a:Int}", [])}
    assert {(r.collection, r.message) for r in C.schema_errors(got).collect()} == {("x", 'Unknown type "B".'), (None, "Query root type must be provided.")}
