"""Naming rules over the nodes of schema texts; each rule is a filter on the node table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sdlweave.functions import text as X
from sdlweave.sdl.documents import arrow_schema, rows_to_batch
from sdlweave.sdl.lexer import SyntaxProblem, position
from sdlweave.sdl.parser import ROOTS, Node, base_name, parse

NODE_FIELDS = [("kind", T.StringType()), ("name", T.StringType()), ("parent", T.StringType()), ("base_type", T.StringType()), ("line", T.IntegerType()), ("column", T.IntegerType()), ("length", T.IntegerType()), ("ordinal", T.IntegerType())]


def nodes_of(text: str) -> list[dict]:
    """Definitions, extensions, fields, input values and enum values in document order; lines and columns from 0."""
    out: list[dict] = []

    def add(n: Node, parent: str | None) -> None:
        line, column = position(text, n.at)
        out.append({"kind": n.kind, "name": n.name, "parent": parent, "base_type": base_name(n.type) or None, "line": line - 1, "column": column - 1, "length": len(n.name), "ordinal": len(out)})

    for d in parse(text):
        if d.kind in ("SchemaDefinition", "SchemaExtension", "Operation", "Fragment"):
            continue
        add(d, None)
        for a in d.args:
            add(a, d.name)
        for f in d.items:
            add(f, d.name)
            for a in f.args:
                add(a, f"{d.name}.{f.name}")
    return out


def nodes(sources: DataFrame, sdl: str = "sdl", keep: str = "path") -> DataFrame:
    """Table function: the nodes of each text; unreadable texts give none."""
    shape = T.StructType([T.StructField(keep, sources.schema[keep].dataType), *[T.StructField(n, t) for n, t in NODE_FIELDS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(shape)
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += [{keep: key, **n} for n in nodes_of(text or "")]
                except SyntaxProblem:
                    continue
            yield rows_to_batch(rows, schema)

    return sources.select(keep, sdl).mapInArrow(run, shape)


@dataclass(frozen=True)
class Rule:
    name: str
    category: str
    when: Column
    message: Column


def _kind(*names: str) -> Column:
    return F.col("kind").isin(*[k for n in names for k in (f"{n}Definition", f"{n}Extension")])


def rules() -> list[Rule]:
    """The catalogue: rules that look at one node. All are enabled by default."""
    name = F.col("name")
    plain = ~name.isin(*ROOTS) & ~name.startswith("__")
    types = _kind("ObjectType", "InterfaceType", "InputObjectType", "EnumType", "UnionType", "ScalarType")
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    affix = lambda rule, category, on, word, begin: Rule(rule, category, on & (name.startswith(word) if begin else name.endswith(word)), say("'", name, f"' should not {'begin' if begin else 'end'} with '{word}'"))
    verb = X.rest_verb(name)
    obj, face, inp, enum = _kind("ObjectType"), _kind("InterfaceType"), _kind("InputObjectType"), _kind("EnumType")
    field = F.col("kind") == "FieldDefinition"
    return [
        Rule("FIELD_NAMES_SHOULD_BE_CAMEL_CASE", "field", field & ~X.is_camel(name), say("field '", name, "' should be camelCase")),
        Rule("RESTY_FIELD_NAMES", "field", field & (verb != ""), say("field '", name, "' should not begin with the verb '", verb, "'")),
        Rule("TYPE_NAMES_SHOULD_BE_PASCAL_CASE", "type", types & plain & ~X.is_pascal(name), say("type '", name, "' should be PascalCase")),
        affix("TYPE_PREFIX", "type", types & plain, "Type", True),
        affix("TYPE_SUFFIX", "type", types & plain, "Type", False),
        affix("OBJECT_PREFIX", "object", obj & plain, "Object", True),
        affix("OBJECT_SUFFIX", "object", obj & plain, "Object", False),
        affix("INTERFACE_PREFIX", "interface", face & ~name.startswith("__"), "Interface", True),
        affix("INTERFACE_SUFFIX", "interface", face & ~name.startswith("__"), "Interface", False),
        Rule("INPUT_ARGUMENT_NAMES_SHOULD_BE_CAMEL_CASE", "input", (F.col("kind") == "InputValueDefinition") & ~X.is_camel(name), say("argument '", name, "' should be camelCase")),
        Rule("INPUT_TYPE_SUFFIX", "input", inp & ~name.endswith("Input"), say("input '", name, "' should end with 'Input'")),
        Rule("ENUM_VALUES_SHOULD_BE_SCREAMING_SNAKE_CASE", "enum", (F.col("kind") == "EnumValueDefinition") & ~X.is_screaming(name), say("value '", name, "' should be SCREAMING_SNAKE_CASE")),
        affix("ENUM_PREFIX", "enum", enum, "Enum", True),
        affix("ENUM_SUFFIX", "enum", enum, "Enum", False),
        Rule("DIRECTIVE_NAMES_SHOULD_BE_CAMEL_CASE", "directive", (F.col("kind") == "DirectiveDefinition") & ~X.is_camel(name), say("directive '", name, "' should be camelCase")),
    ]


USAGE_RULES = ("ENUM_USED_AS_INPUT_WITHOUT_SUFFIX", "ENUM_USED_AS_OUTPUT_DESPITE_SUFFIX")


def used_types(node_rows: DataFrame, keep: str = "path") -> DataFrame:
    """``keep, name, usage``: types used by input values (input) and by fields (output)."""
    usage = F.when(F.col("kind") == "InputValueDefinition", "input").when(F.col("kind") == "FieldDefinition", "output")
    return node_rows.select(keep, F.col("base_type").alias("name"), usage.alias("usage")).filter(F.col("usage").isNotNull() & F.col("name").isNotNull()).distinct()


def lint(node_rows: DataFrame, enabled: Iterable[str] | None = None, keep: str = "path", within: str | None = None) -> DataFrame:
    """``keep, rule, message, line, column, length`` of all violations of the enabled rules (all by default).

    The one-node rules are a single pass; the usage rules are semi-joins of enums with the types used in the same
    text, or in all texts with the same value of ``within``.
    """
    allowed = None if enabled is None else set(enabled)
    on = [r for r in rules() if allowed is None or r.name in allowed]
    shape = [keep, "rule", "message", "line", "column", "length"]
    parts = []
    if on:
        hits = F.filter(F.array(*[F.when(r.when, F.struct(F.lit(r.name).alias("rule"), r.message.alias("message"))) for r in on]), lambda x: x.isNotNull())
        parts.append(node_rows.select(keep, "line", "column", "length", F.explode(hits).alias("h")).select(keep, "h.rule", "h.message", "line", "column", "length"))
    enums, used = node_rows.filter(_kind("EnumType")), used_types(node_rows, within or keep)
    for rule, usage, bad, text in ((USAGE_RULES[0], "input", ~F.col("name").endswith("Input"), "' is used as input and should end with 'Input'"), (USAGE_RULES[1], "output", F.col("name").endswith("Input"), "' ends with 'Input' but is used as output")):
        if allowed is None or rule in allowed:
            hit = enums.filter(bad).join(used.filter(F.col("usage") == usage), [within or keep, "name"], "left_semi")
            parts.append(hit.select(keep, F.lit(rule).alias("rule"), F.concat(F.lit("enum '"), F.col("name"), F.lit(text)).alias("message"), "line", "column", "length"))
    if not parts:
        return node_rows.select(keep, F.lit("").alias("rule"), F.lit("").alias("message"), "line", "column", "length").limit(0)
    return reduce(DataFrame.unionByName, [p.select(*shape) for p in parts])


GROUPS = ("Queries", "Mutations", "Subscriptions", "Types", "Interfaces", "Enums", "Unions", "Inputs", "Scalars")


def outline(node_rows: DataFrame, keep: str = "path") -> DataFrame:
    """``keep, position, grp, n, names``: the non-empty groups of a schema in their fixed order; extensions count."""
    root = F.create_map(*[F.lit(x) for r, g in zip(ROOTS, GROUPS) for x in (r, g)])
    kinds = {"ObjectType": "Types", "InterfaceType": "Interfaces", "EnumType": "Enums", "UnionType": "Unions", "InputObjectType": "Inputs", "ScalarType": "Scalars"}
    by_kind = F.create_map(*[F.lit(x) for k, g in kinds.items() for s in ("Definition", "Extension") for x in (k + s, g)])
    as_field = F.when((F.col("kind") == "FieldDefinition"), root[F.col("parent")])
    as_type = F.when(~F.col("name").isin(*ROOTS) & ~F.col("name").startswith("__"), by_kind[F.col("kind")])
    rows = node_rows.withColumn("grp", F.coalesce(as_field, as_type)).filter(F.col("grp").isNotNull())
    names = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"])
    order = F.array_position(F.array(*[F.lit(g) for g in GROUPS]), F.col("grp")).cast("int")
    return rows.groupBy(keep, "grp").agg(F.count(F.lit(1)).alias("n"), names.alias("names")).select(keep, order.alias("position"), "grp", "n", "names")
