"""Introspection results: the request, error checks, and the schema text printed from a result."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sdlweave.sdl.parser import BUILTIN_SCALARS

_REF = "kind name" + " ofType { kind name" * 7 + " }" * 7
QUERY = (
    "query Introspection { __schema { queryType { name } mutationType { name } subscriptionType { name } "
    "types { kind name description fields(includeDeprecated: true) { name description args { name description type { R } defaultValue } type { R } isDeprecated deprecationReason } "
    "inputFields { name description type { R } defaultValue } interfaces { name } enumValues(includeDeprecated: true) { name description isDeprecated deprecationReason } possibleTypes { name } } "
    "directives { name description locations args { name description type { R } defaultValue } } } }"
).replace("R", _REF)
_BUILTIN_DIRECTIVES = ("skip", "include", "deprecated", "specifiedBy", "oneOf")


def type_ref(t: dict) -> str:
    if t["kind"] == "NON_NULL":
        return type_ref(t["ofType"]) + "!"
    if t["kind"] == "LIST":
        return f"[{type_ref(t['ofType'])}]"
    return t["name"]


def _text(description: str | None, indent: str = "") -> str:
    if not description:
        return ""
    if "\n" in description or '"' in description or "\\" in description:
        quoted = description.replace('"""', '\\"""')
        return f'{indent}"""\n' + "\n".join(indent + x for x in quoted.split("\n")) + f'\n{indent}"""\n'
    return f'{indent}"""{description}"""\n'


def _input(a: dict, indent: str = "") -> str:
    default = f" = {a['defaultValue']}" if a.get("defaultValue") is not None else ""
    return f"{_text(a.get('description'), indent)}{indent}{a['name']}: {type_ref(a['type'])}{default}"


def _args(args: list[dict] | None) -> str:
    if not args:
        return ""
    if any(a.get("description") for a in args):
        return "(\n" + "\n".join(_input(a, "    ") for a in args) + "\n  )"
    return "(" + ", ".join(_input(a) for a in args) + ")"


def _deprecated(x: dict) -> str:
    if not x.get("isDeprecated"):
        return ""
    reason = x.get("deprecationReason")
    return f" @deprecated(reason: {json.dumps(reason)})" if reason and reason != "No longer supported" else " @deprecated"


def to_sdl(result: dict[str, Any]) -> str:
    """Schema text of an introspection result (with or without its ``data`` envelope); built-ins are left out."""
    schema = (result.get("data") or result)["__schema"]
    parts = []
    roots = {k: (schema.get(f"{k}Type") or {}).get("name") for k in ("query", "mutation", "subscription")}
    if any(n and n != k.capitalize() for k, n in roots.items()):
        parts.append("schema {\n" + "\n".join(f"  {k}: {n}" for k, n in roots.items() if n) + "\n}")
    for d in schema.get("directives") or []:
        if d["name"] not in _BUILTIN_DIRECTIVES:
            parts.append(f"{_text(d.get('description'))}directive @{d['name']}{_args(d.get('args'))} on {' | '.join(d['locations'])}")
    for t in schema["types"]:
        if t["name"].startswith("__") or t["name"] in BUILTIN_SCALARS:
            continue
        head, kind = _text(t.get("description")), t["kind"]
        if kind == "SCALAR":
            parts.append(f"{head}scalar {t['name']}")
        elif kind == "UNION":
            parts.append(f"{head}union {t['name']} = {' | '.join(p['name'] for p in t['possibleTypes'])}")
        elif kind == "ENUM":
            parts.append(f"{head}enum {t['name']} {{\n" + "\n".join(f"{_text(v.get('description'), '  ')}  {v['name']}{_deprecated(v)}" for v in t["enumValues"]) + "\n}")
        elif kind == "INPUT_OBJECT":
            parts.append(f"{head}input {t['name']} {{\n" + "\n".join(_input(f, "  ") for f in t["inputFields"]) + "\n}")
        else:
            impl = " implements " + " & ".join(i["name"] for i in t["interfaces"]) if t.get("interfaces") else ""
            fields = "\n".join(f"{_text(f.get('description'), '  ')}  {f['name']}{_args(f.get('args'))}: {type_ref(f['type'])}{_deprecated(f)}" for f in t["fields"])
            parts.append(f"{head}{'type' if kind == 'OBJECT' else 'interface'} {t['name']}{impl} {{\n{fields}\n}}")
    return "\n\n".join(parts) + "\n"


def check(status: int, body: str) -> dict:
    """The result of an HTTP answer; raises ValueError on HTTP errors, reported errors and missing data."""
    if status >= 400:
        raise ValueError(f"HTTP {status}: {body[:200]}")
    try:
        got = json.loads(body)
    except ValueError as e:
        raise ValueError(f"no JSON: {body[:200]}") from e
    if got.get("errors"):
        raise ValueError("; ".join(str(e.get("message", e)) for e in got["errors"]))
    if not (got.get("data") or {}).get("__schema"):
        raise ValueError("no schema in the answer")
    return got


def fetch(endpoint: str, headers: dict[str, str] | None = None, timeout: float = 30) -> str:
    """Schema text of a live endpoint."""
    request = urllib.request.Request(endpoint, json.dumps({"query": QUERY}).encode(), {"Content-Type": "application/json", **(headers or {})})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return to_sdl(check(answer.status, answer.read().decode()))


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.places = [p for p in options.get("path", "").split(",") if p]
        self.endpoints = [p for p in options.get("endpoint", "").split(",") if p]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(("file", p)) for p in self.places] + [InputPartition(("http", p)) for p in self.endpoints]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        how, place = partition.value
        if how == "http":
            yield place, fetch(place)
        else:
            with open(place, encoding="utf-8") as f:
                yield place, to_sdl(json.load(f))


class IntrospectionSource(DataSource):
    """``spark.read.format("introspection")``: ``path, sdl`` of introspection files (``path``) or endpoints (``endpoint``)."""

    @classmethod
    def name(cls) -> str:
        return "introspection"

    def schema(self) -> str:
        return "path string, sdl string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
