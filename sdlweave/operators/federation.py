"""Entities of composed and connected schemas, reference stubs, and the schema without federation parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sdlweave.operators.rows import keep_first
from sdlweave.sdl.documents import arrow_schema, rows_to_batch
from sdlweave.sdl.lexer import SyntaxProblem, compact
from sdlweave.sdl.parser import EnumLiteral, Node, base_name, parse

FIELD = T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())])

#: Directives and types that only serve federation, and the fields it adds to Query.
DIRECTIVES = (
    "link key shareable inaccessible override external provides requires tag extends composeDirective interfaceObject authenticated "
    "requiresScopes policy sourceAPI sourceType sourceField context fromContext join__graph join__type join__field join__implements "
    "join__unionMember join__enumValue join__directive link__Import link__Purpose"
).split()
TYPES = "link__Import link__Purpose join__Graph join__FieldSet join__DirectiveArguments _Any _Entity _Service FieldSet".split()
QUERY_FIELDS = ("_entities", "_service")


def table_function(sources: DataFrame, rows: Callable[[str], list[dict]], fields: list[T.StructField], sdl: str = "sdl", keep: str = "path") -> DataFrame:
    """Rows of a pure function of each text; texts that do not parse give none."""
    shape = T.StructType([T.StructField(keep, sources.schema[keep].dataType), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(shape)
        for b in batches:
            out = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    out += [{keep: key, **r} for r in rows(text or "")]
                except SyntaxProblem:
                    continue
            yield rows_to_batch(out, schema)

    return sources.select(keep, sdl).mapInArrow(run, shape)


def _fields(d: Node) -> list[dict]:
    return [{"name": f.name, "type": f.type} for f in d.items]


def graph_names_of(sdl: str) -> list[dict]:
    """Enum value and subgraph name of each member of the join enum."""
    out = []
    for d in parse(sdl):
        if d.kind == "EnumTypeDefinition" and d.name == "join__Graph":
            for v in d.items:
                name = next((x.argument("name") for x in v.directives if x.name == "join__graph"), None)
                if isinstance(name, str):
                    out.append({"graph": v.name, "subgraph_name": name})
    return out


def join_types_of(sdl: str) -> list[dict]:
    """A row for each directive that joins an object type to a graph by a key."""
    out = []
    for d in parse(sdl):
        if d.kind == "ObjectTypeDefinition":
            for x in d.directives:
                graph, key = x.argument("graph"), x.argument("key")
                if x.name == "join__type" and isinstance(graph, EnumLiteral) and isinstance(key, str) and key:
                    out.append({"ordinal": len(out), "type_name": d.name, "key_fields": key, "graph": graph.name, "fields": _fields(d)})
    return out


_ENTITY = [T.StructField("ordinal", T.IntegerType()), T.StructField("type_name", T.StringType()), T.StructField("key_fields", T.StringType())]


def supergraph_entities(sources: DataFrame, keep: str = "path") -> DataFrame:
    """``keep, ordinal, type_name, key_fields, fields, subgraph_name``; graphs without a name are left out."""
    joins = table_function(sources, join_types_of, [*_ENTITY, T.StructField("graph", T.StringType()), T.StructField("fields", T.ArrayType(FIELD))], keep=keep)
    names = table_function(sources, graph_names_of, [T.StructField("graph", T.StringType()), T.StructField("subgraph_name", T.StringType())], keep=keep)
    return joins.join(names, [keep, "graph"]).drop("graph")


def connect_fields_of(sdl: str) -> list[dict]:
    """Fields marked as entity connectors, with their arguments; and the fields of all object types."""
    out: list[dict] = []
    for d in parse(sdl):
        if d.kind == "ObjectTypeDefinition":
            out += [{"what": "field", "ordinal": 0, "type_name": d.name, "key_fields": None, "args": [f]} for f in _fields(d)]
        if d.kind not in ("ObjectTypeDefinition", "InterfaceTypeDefinition", "ObjectTypeExtension", "InterfaceTypeExtension"):
            continue
        for f in d.items:
            first = next((x for x in f.directives if x.name == "connect"), None)
            if first is not None and first.argument("entity") is True and f.args:
                args = [{"name": a.name, "type": a.type} for a in f.args]
                out.append({"what": "connect", "ordinal": len(out), "type_name": base_name(f.type), "key_fields": " ".join(a["name"] for a in args), "args": args})
    return out


def connect_entities(sources: DataFrame, keep: str = "path", subgraph: str = "subgraph_name") -> DataFrame:
    """``keep, ordinal, type_name, key_fields, fields``: key fields typed by the entity, else by the argument."""
    shape = [T.StructField("what", T.StringType()), *_ENTITY, T.StructField("args", T.ArrayType(FIELD))]
    raw = table_function(sources, connect_fields_of, shape, keep=keep)
    own = raw.filter("what = 'field'").select(keep, "type_name", F.col("args")[0]["name"].alias("arg"), F.col("args")[0]["type"].alias("own_type")).dropDuplicates([keep, "type_name", "arg"])
    wanted = raw.filter("what = 'connect'").select(keep, "ordinal", "type_name", "key_fields", F.posexplode("args").alias("pos", "a")).select(keep, "ordinal", "type_name", "key_fields", "pos", F.col("a.name").alias("arg"), F.col("a.type").alias("arg_type"))
    typed = wanted.join(own, [keep, "type_name", "arg"], "left").withColumn("type", F.coalesce("own_type", "arg_type", F.lit("ID!")))
    fields = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("arg").alias("name"), "type"))), lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type")))
    return typed.groupBy(keep, "ordinal", "type_name", "key_fields").agg(fields.alias("fields"))


#: Both keys of a header with several are found; the pattern takes one key directive after another.
KEY_PATTERN = r'@key\s*\(\s*fields\s*:\s*"([^"]+)"\s*'
HEADER_PATTERN = r"(?:extend\s+)?type\s+(\w+)([^{]*)"


def referenced_keys(texts: DataFrame, text: str = "sdl", keep: str = "path") -> DataFrame:
    """``keep, type_name, key_fields`` already written in a document; works on text that does not parse yet."""
    heads = texts.select(keep, F.explode(F.regexp_extract_all(text, F.lit(HEADER_PATTERN), F.lit(0))).alias("head"))
    named = heads.select(keep, F.regexp_extract("head", HEADER_PATTERN, 1).alias("type_name"), F.explode(F.regexp_extract_all("head", F.lit(KEY_PATTERN), F.lit(1))).alias("key_fields"))
    return named.distinct()


def entity_stubs(entities: DataFrame, own_subgraph: str | None = None, referenced: DataFrame | None = None, default: str = "ID!") -> DataFrame:
    """``type_name, key_fields, stub``: entities of other subgraphs, each pair once, without those already referenced.

    ``entities`` has ``ordinal, type_name, key_fields, subgraph_name, fields``; a key field the entity lacks is ``ID!``.
    """
    others = entities if own_subgraph is None else entities.filter(F.col("subgraph_name") != own_subgraph)
    once = keep_first(others, ["type_name", "key_fields"], ["ordinal", "subgraph_name"])
    if referenced is not None:
        once = once.join(referenced.select("type_name", "key_fields"), ["type_name", "key_fields"], "left_anti")
    keys = F.filter(F.split("key_fields", r"\s+"), lambda x: x != "")
    typed = F.transform(keys, lambda k: F.concat(F.lit("  "), k, F.lit(": "), F.coalesce(F.get(F.filter("fields", lambda f: f["name"] == k), 0)["type"], F.lit(default))))
    stub = F.concat(F.lit("type "), F.col("type_name"), F.lit(' @key(fields: "'), F.col("key_fields"), F.lit('") {\n'), F.array_join(typed, "\n"), F.lit("\n}"))
    return once.select("type_name", "key_fields", stub.alias("stub"), F.concat_ws("_", F.lit("0_entity"), "type_name", "key_fields").alias("sort_key"))


def api_schema(sdl: str) -> str:
    """The text without federation's directives, types and Query fields, in compact form.

    Elements marked inaccessible stay; only the mark goes.
    """
    text = compact(sdl)
    out: list[str] = []
    for d in parse(text):
        if d.name in DIRECTIVES and d.kind == "DirectiveDefinition" or d.name in TYPES and d.kind in ("ScalarTypeDefinition", "ObjectTypeDefinition", "UnionTypeDefinition", "EnumTypeDefinition"):
            continue
        cut = [(x.start, x.end) for n in _walk(d) for x in n.directives if x.name in DIRECTIVES]
        if d.name == "Query":
            cut += [(f.start, f.end) for f in d.items if f.name in QUERY_FIELDS]
        piece, at = [], d.start
        for a, b in sorted(cut):
            if a >= at:
                piece += [text[at:a], " "]
                at = b
        out.append("".join([*piece, text[at : d.end]]))
    return compact(" ".join(out))


def _walk(d: Node) -> Iterator[Node]:
    yield d
    for n in [*d.items, *d.args]:
        yield from _walk(n)
