"""Registered queries of the schema operators over texts made from every row of a table.

``embedding_documents.content`` holds no federation directives, configurations, introspection results or composer
outputs, so for these operators a text is written from each row of ``supplier`` or ``designs`` and the SQL states what must come
out of it from the same columns. A row is a schema of its own, so the work grows with the table.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sdlweave.operators import designs as D
from sdlweave.operators import federation, lint
from sdlweave.operators.validation import validate_operation, validate_schema
from sdlweave.plans.fixtures import _ID
from sdlweave.runtime import table
from sdlweave.sdl.documents import parse_documents, syntax_errors
from sdlweave.sources.files import configs
from sdlweave.sources.introspection import to_sdl

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: ``%k`` and ``%n`` stand for the keys of the supplier and of its nation.
_SHOP = """type Query {
  get_%k(id: ID!, n: Int = %n): S%k
  listS%k: [S%k!]!
}
"Supplier %k"
type S%k {
  id: ID!
  nation%n: Int
}
enum E%k { A%k b%k }
input I%k { x: E%k }
"""
_SUPER = """enum join__Graph { G%k @join__graph(name: "sub-%k", url: "http://%k") LOST }
type S%k @join__type(graph: G%k, key: "id nation%n") @join__type(graph: LOST, key: "id") { id: ID! nation%n: Int secret: Int @inaccessible }
type Query @join__type(graph: G%k) { s: S%k }
directive @join__type(graph: join__Graph!, key: String) repeatable on OBJECT"""
_CONNECT = """type Query { s%k(id: ID!, region%n: String): S%k @connect(source: "v", entity: true) off(id: ID!): S%k @connect(entity: false) }
type S%k { id: String! nation: Int }"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def filled(template: str) -> Column:
    keys = {"%k": "s_suppkey", "%n": "s_nationkey"}
    return F.concat(*[F.col(keys[p]).cast("string") if p in keys else F.lit(p) for p in re.split("(%[kn])", template) if p])


def texts(spark: SparkSession, d: str, template: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("key"), filled(template).alias("sdl"))


def _written(template: str) -> str:
    """The template as a SQL expression."""
    quoted = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return "(" + quoted.replace("%k", "' || s_suppkey || '").replace("%n", "' || s_nationkey || '") + ")"


def _rows(columns: dict[str, str], *rows: dict[str, str], where: str = "") -> str:
    """SQL of some rows per supplier; ``columns`` gives the expressions that all share."""
    return " union all ".join("select s_suppkey::bigint as key, " + ", ".join(f"{e} as {n}" for n, e in {**columns, **r}.items()) + f" from supplier{where}" for r in rows)


_W = _written


@query(f"select {_ID} as id, * from (" + _rows({"parent": "'Query'", "root": "'Query'"}, {"name": _W("get_%k"), "content": _W("Query.get_%k(id:ID!n:Int=%n):S%k"), "field_type": _W("S%k")}, {"name": _W("listS%k"), "content": _W("Query.listS%k:[S%k!]!"), "field_type": _W("[S%k!]!")}) + ")")
def sdl_root_fields(spark, d):
    m = F.col("metadata")
    docs = parse_documents(texts(spark, d, _SHOP), keep="key").filter("metadata.isRootOperationField")
    return docs.select("key", "id", "name", "content", m["parentType"].alias("parent"), m["fieldType"].alias("field_type"), m["rootOperationType"].alias("root"))


@query(_rows({}, {"type": "'object'", "name": _W("S%k"), "description": _W("Supplier %k"), "content": _W('"Supplier %k" type S%k{id:ID!nation%n:Int}'), "n_fields": "2"}, {"type": "'enum'", "name": _W("E%k"), "description": "null", "content": _W("enum E%k{A%k b%k}"), "n_fields": "-1"}, {"type": "'input'", "name": _W("I%k"), "description": "null", "content": _W("input I%k{x:E%k}"), "n_fields": "1"}))
def sdl_types(spark, d):
    docs = parse_documents(texts(spark, d, _SHOP), keep="key").filter("type <> 'field'")
    return docs.select("key", "type", "name", "description", "content", F.coalesce(F.size("metadata.fields"), F.lit(-1)).alias("n_fields"))


@query(_rows({"message": "'Syntax Error: Expected Name, found }.'"}, {"line": "2", '"column"': "6 + length(s_suppkey::varchar)"}))
def sdl_syntax_errors(spark, d):
    return syntax_errors(texts(spark, d, "type A {\n  x%k: }"), keep="key")


@query(_rows({}, {"rule": "'FIELD_NAMES_SHOULD_BE_CAMEL_CASE'", "line": "1", "length": "4 + length(s_suppkey::varchar)"}, {"rule": "'RESTY_FIELD_NAMES'", "line": "2", "length": "5 + length(s_suppkey::varchar)"}, {"rule": "'ENUM_VALUES_SHOULD_BE_SCREAMING_SNAKE_CASE'", "line": "9", "length": "1 + length(s_suppkey::varchar)"}, {"rule": "'INPUT_TYPE_SUFFIX'", "line": "10", "length": "1 + length(s_suppkey::varchar)"}, {"rule": "'ENUM_USED_AS_INPUT_WITHOUT_SUFFIX'", "line": "9", "length": "1 + length(s_suppkey::varchar)"}))
def sdl_lint(spark, d):
    return lint.lint(lint.nodes(texts(spark, d, _SHOP), keep="key"), keep="key").select("key", "rule", "line", "length")


@query(_rows({}, {"position": "1", "grp": "'Queries'", "n": "2::bigint", "first": _W("get_%k")}, {"position": "4", "grp": "'Types'", "n": "1", "first": _W("S%k")}, {"position": "6", "grp": "'Enums'", "n": "1", "first": _W("E%k")}, {"position": "8", "grp": "'Inputs'", "n": "1", "first": _W("I%k")}))
def sdl_outline(spark, d):
    return lint.outline(lint.nodes(texts(spark, d, _SHOP), keep="key"), keep="key").select("key", "position", "grp", "n", F.col("names")[0].alias("first"))


@query(_rows({}, {"type_name": _W("S%k"), "key_fields": _W("id nation%n"), "subgraph_name": _W("sub-%k"), "n_fields": "3"}))
def sdl_entities(spark, d):
    return federation.supergraph_entities(texts(spark, d, _SUPER), keep="key").select("key", "type_name", "key_fields", "subgraph_name", F.size("fields").alias("n_fields"))


@query(_rows({}, {"type_name": _W("S%k"), "key_fields": _W("id region%n"), "names": _W("id,region%n"), "types": "'String!,String'"}))
def sdl_connect_entities(spark, d):
    e = federation.connect_entities(texts(spark, d, _CONNECT), keep="key")
    part = lambda n: F.array_join(F.transform("fields", lambda f: f[n]), ",")
    return e.select("key", "type_name", "key_fields", part("name").alias("names"), part("type").alias("types"))


@query(f"select {_W('S%k')} as type_name, {_W('id region%n')} as key_fields, {_W('type S%k @key(fields: \"id region%n\") {')} || chr(10) || '  id: String!' || chr(10) || {_W('  region%n: String')} || chr(10) || '}}' as stub from supplier where s_nationkey <> 3 and s_suppkey % 7 <> 1")
def sdl_entity_stubs(spark, d):
    """Entities of all suppliers, without a nation's (already referenced) and the suppliers of one subgraph (its own)."""
    e = federation.connect_entities(texts(spark, d, _CONNECT), keep="key").withColumn("subgraph_name", F.concat(F.lit("sub-"), (F.col("key") % 7).cast("string")))
    written = table(spark, d, "supplier").filter("s_nationkey = 3").select(F.col("s_suppkey").alias("path"), filled('type S%k @key(fields: "id region%n") { id').alias("sdl"))
    return federation.entity_stubs(e, "sub-1", federation.referenced_keys(written)).select("type_name", "key_fields", "stub")


@query(_rows({}, {"api": _W("type S%k{id:ID!nation%n:Int secret:Int}type Query{s:S%k}")}))
def sdl_api_schema(spark, d):
    return federation.table_function(texts(spark, d, _SUPER), lambda sdl: [{"api": federation.api_schema(sdl)}], [T.StructField("api", T.StringType())], keep="key")


@query(_rows({}, {"target": _W("S%k"), "line": "5", '"column"': "5", "end_column": "6 + length(s_suppkey::varchar)"}, {"target": _W("S%k.nation%n"), "line": "7", '"column"': "2", "end_column": "13 + length(s_nationkey::varchar)"}, {"target": _W("S%k.none"), "line": "5", '"column"': "5", "end_column": "6 + length(s_suppkey::varchar)"}))
def locate_fields(spark, d):
    asked = F.explode(F.array(filled("S%k"), filled("S%k.nation%n"), filled("S%k.none"), F.lit("Missing"))).alias("target")
    t = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("key"), filled(_SHOP).alias("sdl"), asked)
    return t.select("key", "target", D.locate_column(F.col("sdl"), F.col("target")).alias("p")).filter("p is not null").select("key", "target", "p.line", "p.column", "p.end_column")


@query("select design_id, s.name as name, regexp_extract(config_path, '^(.*)/', 1) || '/parts/' || s.name || '.graphql' as schema_path, s.routing_url as routing_url, '=2.9.1' as version, 1 as line from (select design_id, config_path, unnest(subgraphs) as s from designs where type = 'federated')")
def config_subgraphs(spark, d):
    """A configuration is written from each federated design and read back."""
    one = lambda s: F.concat(F.lit("  "), s["name"], F.lit(":\n    routing_url: "), F.coalesce(s["routing_url"], F.lit("null")), F.lit("\n    schema:\n      file: ./parts/"), s["name"], F.lit(".graphql\n"))
    ds = table(spark, d, "designs").filter("type = 'federated' and subgraphs is not null")
    text = F.concat(F.lit("federation_version: =2.9.1\nsubgraphs:\n"), F.array_join(F.transform("subgraphs", one), ""))
    files = ds.select(F.concat_ws("/", F.regexp_extract("config_path", "^(.*)/", 1), F.concat(F.col("design_id").cast("string"), F.lit(".yaml"))).alias("path"), text.alias("value"))
    c = configs(files).select(F.regexp_extract("path", r"(\d+)\.yaml$", 1).cast("long").alias("design_id"), F.explode("subgraphs").alias("s"), F.col("federation_version").alias("version"), F.col("federation_version_line").alias("line"))
    return c.select("design_id", "s.name", "s.schema_path", "s.routing_url", "version", "line")


_RESULT = '{"data": {"__schema": {"queryType": {"name": "Query"}, "types": [{"kind": "OBJECT", "name": "Query", "interfaces": [], "fields": [{"name": "s%k", "args": [{"name": "n", "type": {"kind": "SCALAR", "name": "Int"}, "defaultValue": "%n"}], "type": {"kind": "NON_NULL", "ofType": {"kind": "ENUM", "name": "E%k"}}}]}, {"kind": "ENUM", "name": "E%k", "enumValues": [{"name": "A%n"}]}, {"kind": "SCALAR", "name": "Int"}]}}}'


@query(_rows({}, {"n": "1", "part": _W("type Query {\n  s%k(n: Int = %n): E%k!\n}")}, {"n": "2", "part": _W("enum E%k {\n  A%n\n}")}))
def introspection_sdl(spark, d):
    def rows(result: str) -> list[dict]:
        return [{"n": i, "part": p} for i, p in enumerate(to_sdl(json.loads(result)).strip().split("\n\n"), 1)]

    return federation.table_function(texts(spark, d, _RESULT), rows, [T.StructField("n", T.IntegerType()), T.StructField("part", T.StringType())], keep="key")


_OUTPUT = '{"error": {"details": {"build_errors": [{"message": "[NATION_%n] S%k fails", "code": "X", "nodes": [{"subgraph": "nation_%n", "start": {"line": 5, "column": 2}, "end": {"line": 6, "column": 4}}]}, {"message": "\\"NATION_%n\\" and \\"NATION_99\\" differ", "code": "Y", "nodes": []}]}}}'
_PLACED = f"select s_suppkey::bigint as key, e as error_no, 'NATION_' || s_nationkey as subgraph_name, 'n/' || s_nationkey || '.graphql' as file, case when e = 0 then {_W('[NATION_%n] S%k fails')} else {_W('\"NATION_%n\" and \"NATION_99\" differ')} end as message, case when e = 0 then 4 else -1 end as line, case when e = 0 then 2 else -1 end as \"column\" from supplier, (select unnest([0, 1]) as e)"


def _placed(spark: SparkSession, d: str) -> DataFrame:
    errors = D.build_errors(texts(spark, d, _OUTPUT), "sdl", "key")
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("subgraph_pos"), F.col("n_name").alias("subgraph_name"), F.concat(F.lit("n/"), F.col("n_nationkey").cast("string"), F.lit(".graphql")).alias("schema_path"))
    return D.place_errors(errors, nations, "key")


@query(_PLACED)
def compose_errors(spark, d):
    return _placed(spark, d).select("key", "error_no", "subgraph_name", "file", "message", F.coalesce("line", F.lit(-1)).alias("line"), F.coalesce("column", F.lit(-1)).alias("column"))


@query(f"select file, count(*) as n, min(message) as first from ({_PLACED}) group by file")
def diagnostics_by_file(spark, d):
    g = D.group_diagnostics(_placed(spark, d).withColumn("severity", F.lit("error")))
    return g.select("file", "n", F.array_min(F.transform("diagnostics", lambda x: x["message"])).alias("first"))


@query(_rows({}, {"operation": _W("{ s%k }"), "message": "null"}, {"operation": _W("{ t%k }"), "message": _W('Cannot query field "t%k" on type "Query".')}, {"operation": _W("{ s%k { a } t: s%k }"), "message": _W('Field "s%k" must not have a selection since type "Int" has no subfields.')}))
def operation_checks(spark, d):
    def rows(both: str) -> list[dict]:
        sdl, *asked = both.split("\n")
        return [{"operation": o, "message": next(iter(validate_operation(o, sdl)), None)} for o in asked]

    sources = texts(spark, d, "type Query { s%k: Int }\n{ s%k }\n{ t%k }\n{ s%k { a } t: s%k }")
    return federation.table_function(sources, rows, [T.StructField("operation", T.StringType()), T.StructField("message", T.StringType())], keep="key")


@query(_rows({}, {"message": _W('Unknown type "B%k".')}, where=" where s_suppkey % 2 = 1"))
def schema_checks(spark, d):
    """Every second supplier's schema names a type that is not there."""
    both = F.when(F.col("key") % 2 == 1, F.col("sdl")).otherwise(F.concat("sdl", F.lit(" type B"), F.col("key").cast("string"), F.lit(" { x: Int }")))
    sources = texts(spark, d, "type Query { a: B%k }").withColumn("sdl", both)
    return federation.table_function(sources, lambda sdl: [{"message": e["message"]} for e in validate_schema(sdl)], [T.StructField("message", T.StringType())], keep="key")
