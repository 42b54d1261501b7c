"""Checks of schema texts and of operations against a schema."""

from __future__ import annotations

import json
import re
from collections import Counter

from sdlweave.sdl.lexer import SyntaxProblem, position
from sdlweave.sdl.parser import BUILTIN_SCALARS, ROOTS, EnumLiteral, Node, Variable, base_name, parse

_KINDS = {"ObjectType", "InterfaceType", "InputObjectType", "EnumType", "UnionType", "ScalarType"}


class Schema:
    """Type definitions with their extensions merged."""

    def __init__(self, definitions: list[Node]) -> None:
        self.types: dict[str, Node] = {}
        self.roots = {r.lower(): r for r in ROOTS}
        for d in definitions:
            kind = d.kind.replace("Definition", "").replace("Extension", "")
            if kind == "Schema":
                self.roots |= {x.name: base_name(x.type) for x in d.items}
            elif kind in _KINDS:
                if d.name in self.types:
                    t = self.types[d.name]
                    t.items, t.names = t.items + d.items, t.names + d.names
                else:
                    self.types[d.name] = Node(kind, d.name, d.start, d.end, d.at, items=list(d.items), names=list(d.names))

    def kind(self, name: str) -> str | None:
        return "ScalarType" if name in BUILTIN_SCALARS else self.types[name].kind if name in self.types else None

    def field(self, parent: str, name: str) -> Node | None:
        return next((f for f in self.types[parent].items if f.name == name), None) if parent in self.types else None


def validate_schema(sdl: str | None) -> list[dict]:
    """Errors of the first failing phase: reading, then building (names and references), then rules of types.

    ``message, line, column`` (from 1). Covered: empty text, syntax, repeated types, fields and values, unknown
    types, a missing Query, empty types, interfaces that are not implemented, kinds used in the wrong place.
    """
    if not sdl or not sdl.strip():
        return [{"message": "Schema is empty", "line": 1, "column": 1}]
    try:
        defs = parse(sdl)
    except SyntaxProblem as e:
        return [{"message": e.message, "line": e.line, "column": e.column}]
    out: list[dict] = []

    def report(message: str, node: Node) -> None:
        line, column = position(sdl, node.at)
        out.append({"message": message, "line": line, "column": column})

    types = [d for d in defs if d.kind.endswith("Definition") and d.kind[: -len("Definition")] in _KINDS]
    seen: Counter = Counter()
    for d in types:
        seen[d.name] += 1
        if seen[d.name] > 1:
            report(f'There can be only one type named "{d.name}".', d)
    schema = Schema(defs)
    for d in defs:
        if d.kind.endswith("Extension") and d.name and not seen[d.name]:
            report(f'Cannot extend type "{d.name}" because it is not defined.', d)
        names = Counter()
        for f in d.items if d.kind != "SchemaDefinition" else []:
            names[f.name] += 1
            if names[f.name] > 1:
                report(f'"{d.name}.{f.name}" can only be defined once.', f)
            for n in [f, *f.args]:
                if n.type and schema.kind(base_name(n.type)) is None:
                    report(f'Unknown type "{base_name(n.type)}".', n)
        for a in d.args:
            if a.type and schema.kind(base_name(a.type)) is None:
                report(f'Unknown type "{base_name(a.type)}".', a)
        if d.kind != "DirectiveDefinition":
            for n in d.names:
                if schema.kind(n) is None:
                    report(f'Unknown type "{n}".', d)
    if out:
        return out
    if schema.roots["query"] not in schema.types:
        out.append({"message": "Query root type must be provided.", "line": 1, "column": 1})
    for d in types:
        t = schema.types[d.name]
        if t.kind != "ScalarType" and not (t.names if t.kind == "UnionType" else t.items):
            report(f"Type {d.name} must define one or more members.", d)
        for f in t.items:
            for n, place in ((f, "input" if t.kind == "InputObjectType" else "output"), *((a, "input") for a in f.args)):
                kind = schema.kind(base_name(n.type)) if n.type else None
                if place == "input" and kind in ("ObjectType", "InterfaceType", "UnionType"):
                    report(f'The type of "{d.name}.{n.name}" must be an input type.', n)
                if place == "output" and kind == "InputObjectType":
                    report(f'The type of "{d.name}.{n.name}" must be an output type.', n)
        if t.kind == "UnionType":
            for n in t.names:
                if schema.kind(n) != "ObjectType":
                    report(f"Union type {d.name} can only include object types, it cannot include {n}.", d)
        if t.kind in ("ObjectType", "InterfaceType"):
            for i in t.names:
                if schema.kind(i) != "InterfaceType":
                    report(f"Type {d.name} must only implement interface types, it cannot implement {i}.", d)
                    continue
                for want in schema.types[i].items:
                    got = schema.field(d.name, want.name)
                    if got is None:
                        report(f"Interface field {i}.{want.name} expected but {d.name} does not provide it.", d)
                    elif not _covariant(schema, got.type, want.type):
                        report(f"Interface field {i}.{want.name} expects type {want.type} but {d.name}.{want.name} is type {got.type}.", got)
    return out


def _covariant(schema: Schema, got: str, want: str) -> bool:
    if got == want:
        return True
    if got.endswith("!"):
        return _covariant(schema, got[:-1], want[:-1] if want.endswith("!") else want)
    if want.endswith("!"):
        return False
    if got.startswith("[") and want.startswith("["):
        return _covariant(schema, got[1:-1], want[1:-1])
    if got.startswith("[") or want.startswith("["):
        return False
    t = schema.types.get(want)
    return bool(t) and (want in schema.types[got].names if t.kind == "InterfaceType" and got in schema.types else t.kind == "UnionType" and got in t.names)


def validate_operation(operation: str, sdl: str | None) -> list[str]:
    """Messages; empty means valid. Without a schema only the syntax is checked.

    Covered rules: unknown fields, leaf and composite selections, unknown and missing arguments, unknown fragments and
    variables, unknown variable types, literals of the wrong scalar or enum, several anonymous operations.
    """
    return validate_operations([operation], sdl)[0]


def validate_operations(operations: list[str], sdl: str | None) -> list[list[str]]:
    """The messages of each operation; the schema is read once."""
    try:
        schema = Schema(parse(sdl)) if sdl else None
    except SyntaxProblem as e:
        schema = e.message
    return [_operation(o, schema) for o in operations]


def _operation(operation: str, schema: Schema | str | None) -> list[str]:
    try:
        defs = parse(operation)
    except SyntaxProblem as e:
        return [e.message]
    if not isinstance(schema, Schema):
        return [schema] if schema else []
    out: list[str] = []
    fragments = {d.name: d for d in defs if d.kind == "Fragment"}
    operations = [d for d in defs if d.kind == "Operation"]
    if len(operations) > 1 and any(not d.name for d in operations):
        out.append("This anonymous operation must be the only defined operation.")
    for d in operations:
        root = schema.roots.get(d.type)
        if root not in schema.types:
            out.append(f"Schema is not configured to execute {d.type} operation.")
            continue
        for v in d.args:
            if schema.kind(base_name(v.type)) is None:
                out.append(f'Unknown type "{base_name(v.type)}".')
        _select(schema, root, d.items, {v.name: v.type for v in d.args}, fragments, out, ())
    for f in fragments.values():
        if schema.kind(f.type) is None:
            out.append(f'Unknown type "{f.type}".')
    return list(dict.fromkeys(out))


def _select(schema: Schema, parent: str, selections: list[Node], variables: dict, fragments: dict, out: list[str], inside: tuple) -> None:
    for s in selections:
        if s.kind == "FragmentSpread":
            f = fragments.get(s.name)
            if f is None:
                out.append(f'Unknown fragment "{s.name}".')
            elif s.name in inside:
                out.append(f'Cannot spread fragment "{s.name}" within itself.')
            elif f.type in schema.types:
                _select(schema, f.type, f.items, variables, fragments, out, (*inside, s.name))
            continue
        if s.kind == "InlineFragment":
            if s.type and schema.kind(s.type) is None:
                out.append(f'Unknown type "{s.type}".')
            else:
                _select(schema, s.type or parent, s.items, variables, fragments, out, inside)
            continue
        if s.name.startswith("__"):
            continue
        f = schema.field(parent, s.name) if schema.kind(parent) in ("ObjectType", "InterfaceType") else None
        if f is None:
            out.append(f'Cannot query field "{s.name}" on type "{parent}".')
            continue
        given = {a.name: a.value for a in s.args}
        known = {a.name: a for a in f.args}
        for name, value in given.items():
            if name not in known:
                out.append(f'Unknown argument "{name}" on field "{parent}.{s.name}".')
            else:
                _literal(schema, known[name].type, value, variables, out)
        for a in f.args:
            if a.type.endswith("!") and a.value is None and given.get(a.name) is None:
                out.append(f'Field "{s.name}" argument "{a.name}" of type "{a.type}" is required, but it was not provided.')
        target, composite = base_name(f.type), schema.kind(base_name(f.type)) in ("ObjectType", "InterfaceType", "UnionType")
        if composite and not s.items:
            out.append(f'Field "{s.name}" of type "{f.type}" must have a selection of subfields.')
        elif s.items and not composite:
            out.append(f'Field "{s.name}" must not have a selection since type "{f.type}" has no subfields.')
        elif s.items:
            _select(schema, target, s.items, variables, fragments, out, inside)


def _literal(schema: Schema, ref: str, value, variables: dict, out: list[str]) -> None:
    if isinstance(value, Variable):
        if value.name not in variables:
            out.append(f'Variable "${value.name}" is not defined.')
        elif base_name(variables[value.name]) != base_name(ref):
            out.append(f'Variable "${value.name}" of type "{variables[value.name]}" used in position expecting type "{ref}".')
        return
    if value is None:
        if ref.endswith("!"):
            out.append(f'Expected value of type "{ref}", found null.')
        return
    inner = ref.rstrip("!")
    if inner.startswith("["):
        for v in value if isinstance(value, list) else [value]:
            _literal(schema, inner[1:-1], v, variables, out)
        return
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    fits = {"Int": isinstance(value, int) and number, "Float": number, "String": isinstance(value, str), "Boolean": isinstance(value, bool), "ID": isinstance(value, str) or (isinstance(value, int) and number)}
    kind = schema.kind(inner)
    if inner in fits and not fits[inner]:
        out.append(f"{inner} cannot represent value: {value!r}")
    elif kind == "EnumType" and (not isinstance(value, EnumLiteral) or value.name not in [v.name for v in schema.types[inner].items]):
        out.append(f'Value "{getattr(value, "name", value)}" does not exist in "{inner}" enum.')
    elif kind == "InputObjectType" and isinstance(value, dict):
        known = {f.name: f for f in schema.types[inner].items}
        for k, v in value.items():
            if k not in known:
                out.append(f'Field "{k}" is not defined by type "{inner}".')
            else:
                _literal(schema, known[k].type, v, variables, out)
        for f in known.values():
            if f.type.endswith("!") and f.value is None and f.name not in value:
                out.append(f'Field "{inner}.{f.name}" of required type "{f.type}" was not provided.')


_NO_FIELD = re.compile(r"""type [`'"]?(\w+)[`'"]? does not have a field [`'"]?(\w+)[`'"]""", re.I)


def read_validation(text: str) -> tuple[bool, list[str]]:
    """A validation service's answer: JSON first, else text; empty text counts as valid."""
    try:
        got = json.loads(text)
        if isinstance(got, dict) and isinstance(got.get("valid"), bool):
            return got["valid"], list(got.get("errors") or [])
    except ValueError:
        pass
    lines = [x.strip() for x in text.strip().split("\n")]
    if lines in ([""], ["Operation is valid"]):
        return True, []
    errors = []
    for line, after in zip(lines, [*lines[1:], ""]):
        if line[:6].lower() == "error:":
            m = _NO_FIELD.search(line)
            said = f'Cannot query field "{m[2]}" on type "{m[1]}".' if m else line[6:].strip()
            errors.append(f"{said}\n{after}" if after.lower().startswith("note: path to the field:") else said)
    return False, errors or [x for x in lines if x]


def first_event(stream: str) -> str | None:
    """Data of the first server-sent event that is not the end mark."""
    for line in stream.splitlines():
        if line.startswith("data: ") and line[6:].strip() != "[DONE]":
            return line[6:]
    return None
