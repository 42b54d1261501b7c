"""Recursive-descent parser for schema documents and operations, without dependencies."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from sdlweave.sdl.lexer import SyntaxProblem, Token, position, string_value, tokens

ROOTS = ("Query", "Mutation", "Subscription")
BUILTIN_SCALARS = ("ID", "String", "Int", "Float", "Boolean")


@dataclass
class Node:
    """One syntax node. ``start`` and ``end`` are offsets, ``at`` that of the name."""

    kind: str
    name: str = ""
    start: int = 0
    end: int = 0
    at: int = 0
    description: str | None = None
    type: str | None = None  # rendered type reference
    value: Any = None
    extension: bool = False
    items: list[Node] = field(default_factory=list)  # fields, values, selections
    args: list[Node] = field(default_factory=list)
    names: list[str] = field(default_factory=list)  # interfaces, union members, locations
    directives: list[Node] = field(default_factory=list)

    def argument(self, name: str) -> Any:
        return next((a.value for a in self.args if a.name == name), None)


def base_name(ref: str | None) -> str:
    return (ref or "").translate({91: None, 93: None, 33: None}).strip()


@dataclass(frozen=True)
class EnumLiteral:
    name: str


@dataclass(frozen=True)
class Variable:
    name: str


class Parser:
    def __init__(self, text: str) -> None:
        self.text, self.ts, self.i = text, tokens(text), 0

    # -- reading --------------------------------------------------------------------------------
    @property
    def t(self) -> Token:
        return self.ts[self.i]

    def fail(self, wanted: str = "") -> SyntaxProblem:
        t = self.t
        shown = t.text if t.kind in ("punct", "end") else f'{t.kind.capitalize()} "{t.text}"'
        return SyntaxProblem(f"Syntax Error: {f'Expected {wanted}, found' if wanted else 'Unexpected'} {shown}.", *position(self.text, t.start))

    def next(self) -> Token:
        t = self.t
        self.i += 1
        return t

    def sees(self, text: str) -> bool:
        return self.t.text == text and self.t.kind in ("punct", "name")

    def skip(self, text: str) -> bool:
        if self.sees(text):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> Token:
        if not self.sees(text):
            raise self.fail(f'"{text}"')
        return self.next()

    def name(self) -> Token:
        if self.t.kind != "name":
            raise self.fail("Name")
        return self.next()

    def many(self, opening: str, item, closing: str, optional: bool = True) -> list:
        if optional and not self.sees(opening):
            return []
        self.need(opening)
        out = [item()]
        while not self.skip(closing):
            out.append(item())
        return out

    def finish(self, node: Node) -> Node:
        node.end = self.ts[self.i - 1].end
        return node

    # -- shared parts ---------------------------------------------------------------------------
    def type_ref(self) -> str:
        if self.skip("["):
            inner = f"[{self.type_ref()}]"
            self.need("]")
        else:
            inner = self.name().text
        return inner + "!" if self.skip("!") else inner

    def literal(self, constant: bool = False) -> Any:
        t = self.next()
        if t.text == "[" and t.kind == "punct":
            out = []
            while not self.skip("]"):
                out.append(self.literal(constant))
            return out
        if t.text == "{" and t.kind == "punct":
            obj = {}
            while not self.skip("}"):
                key = self.name().text
                self.need(":")
                obj[key] = self.literal(constant)
            return obj
        if t.text == "$" and t.kind == "punct" and not constant:
            return Variable(self.name().text)
        if t.kind in ("string", "block"):
            return string_value(t)
        if t.kind == "number":
            return float(t.text) if any(c in t.text for c in ".eE") else int(t.text)
        if t.kind == "name":
            return {"true": True, "false": False, "null": None}.get(t.text, EnumLiteral(t.text))
        self.i -= 1
        raise self.fail()

    def arguments(self, constant: bool = False) -> list[Node]:
        def one() -> Node:
            n = self.name()
            self.need(":")
            return self.finish(Node("Argument", n.text, n.start, at=n.start, value=self.literal(constant)))

        return self.many("(", one, ")")

    def directives(self, constant: bool = True) -> list[Node]:
        out = []
        while self.sees("@"):
            start = self.next().start
            n = self.name()
            out.append(self.finish(Node("Directive", n.text, start, at=n.start, args=self.arguments(constant))))
        return out

    def description(self) -> tuple[int, str | None]:
        if self.t.kind in ("string", "block"):
            t = self.next()
            return t.start, string_value(t)
        return self.t.start, None

    # -- schema definitions ---------------------------------------------------------------------
    def input_value(self) -> Node:
        start, text = self.description()
        n = self.name()
        self.need(":")
        node = Node("InputValueDefinition", n.text, start, at=n.start, description=text, type=self.type_ref())
        if self.skip("="):
            node.value = ("default", self.literal(True))
        node.directives = self.directives()
        return self.finish(node)

    def field_definition(self) -> Node:
        start, text = self.description()
        n = self.name()
        node = Node("FieldDefinition", n.text, start, at=n.start, description=text)
        node.args = self.many("(", self.input_value, ")")
        self.need(":")
        node.type = self.type_ref()
        node.directives = self.directives()
        return self.finish(node)

    def enum_value(self) -> Node:
        start, text = self.description()
        if self.t.text in ("true", "false", "null"):
            raise self.fail()
        n = self.name()
        return self.finish(Node("EnumValueDefinition", n.text, start, at=n.start, description=text, directives=self.directives()))

    def interfaces(self) -> list[str]:
        if not self.skip("implements"):
            return []
        self.skip("&")
        out = [self.name().text]
        while self.skip("&"):
            out.append(self.name().text)
        return out

    def definition(self) -> Node:
        start, text = self.description()
        if text is None and (self.sees("{") or self.t.text in ("query", "mutation", "subscription", "fragment")):
            return self.executable()
        extension = self.skip("extend")
        word = self.name().text
        kinds = {"type": "ObjectType", "interface": "InterfaceType", "input": "InputObjectType", "enum": "EnumType", "union": "UnionType", "scalar": "ScalarType", "schema": "Schema", "directive": "Directive"}
        if word not in kinds or (extension and word == "directive"):
            self.i -= 1
            raise self.fail()
        node = Node(kinds[word] + ("Extension" if extension else "Definition"), start=start, description=text, extension=extension)
        if word == "directive":
            self.need("@")
        if word != "schema":
            n = self.name()
            node.name, node.at = n.text, n.start
        if word in ("type", "interface"):
            node.names = self.interfaces()
        if word == "directive":
            node.args = self.many("(", self.input_value, ")")
            node.value = self.skip("repeatable")
            self.need("on")
            self.skip("|")
            node.names = [self.name().text]
            while self.skip("|"):
                node.names.append(self.name().text)
            return self.finish(node)
        node.directives = self.directives()
        if word in ("type", "interface"):
            node.items = self.many("{", self.field_definition, "}")
        elif word == "input":
            node.items = self.many("{", self.input_value, "}")
        elif word == "enum":
            node.items = self.many("{", self.enum_value, "}")
        elif word == "union" and self.skip("="):
            self.skip("|")
            node.names = [self.name().text]
            while self.skip("|"):
                node.names.append(self.name().text)
        elif word == "schema":
            def root() -> Node:
                n = self.name()
                self.need(":")
                return self.finish(Node("OperationType", n.text, n.start, at=n.start, type=self.type_ref()))

            node.items = self.many("{", root, "}", optional=extension)
        return self.finish(node)

    # -- operations -----------------------------------------------------------------------------
    def executable(self) -> Node:
        start = self.t.start
        if self.sees("{"):
            return self.finish(Node("Operation", "", start, type="query", items=self.selections()))
        word = self.next().text
        if word == "fragment":
            n = self.name()
            self.need("on")
            node = Node("Fragment", n.text, start, at=n.start, type=self.name().text)
        else:
            node = Node("Operation", "", start, type=word)
            if self.t.kind == "name":
                n = self.next()
                node.name, node.at = n.text, n.start
            node.args = self.many("(", self.variable, ")")
        node.directives = self.directives(False)
        node.items = self.selections()
        return self.finish(node)

    def variable(self) -> Node:
        start = self.need("$").start
        n = self.name()
        self.need(":")
        node = Node("VariableDefinition", n.text, start, at=n.start, type=self.type_ref())
        if self.skip("="):
            node.value = ("default", self.literal(True))
        node.directives = self.directives()
        return self.finish(node)

    def selections(self) -> list[Node]:
        return self.many("{", self.selection, "}", optional=False)

    def selection(self) -> Node:
        start = self.t.start
        if self.skip("..."):
            if self.t.kind == "name" and self.t.text != "on":
                n = self.next()
                return self.finish(Node("FragmentSpread", n.text, start, at=n.start, directives=self.directives(False)))
            node = Node("InlineFragment", "", start, at=start)
            if self.skip("on"):
                node.type = self.name().text
            node.directives = self.directives(False)
            node.items = self.selections()
            return self.finish(node)
        n = self.name()
        node = Node("Field", n.text, start, at=n.start)
        if self.skip(":"):
            node.value = n.text  # the alias
            n = self.name()
            node.name, node.at = n.text, n.start
        node.args = self.arguments()
        node.directives = self.directives(False)
        if self.sees("{"):
            node.items = self.selections()
        return self.finish(node)


def parse(text: str) -> list[Node]:
    """All definitions of a document; raises :class:`SyntaxProblem`."""
    p = Parser(text)
    out = [p.definition()]
    while p.t.kind != "end":
        out.append(p.definition())
    return out
