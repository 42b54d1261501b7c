"""Tokens of the schema language, and the compact form of a text."""

from __future__ import annotations

import re
from typing import NamedTuple


class SyntaxProblem(ValueError):
    """A text that does not lex or parse; ``line`` and ``column`` count from 1."""

    def __init__(self, message: str, line: int, column: int) -> None:
        super().__init__(message)
        self.message, self.line, self.column = message, line, column


class Token(NamedTuple):
    kind: str  # name, number, string, block, punct, end
    text: str
    start: int
    end: int


_IGNORED = re.compile(r"(?:[\ufeff\t ,\n\r]|#[^\n\r]*)*")
_TOKEN = re.compile(
    r'(?P<block>"""(?:\\"""|(?!""")[\s\S])*""")'
    r'|(?P<string>"(?:\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}|u\{[0-9A-Fa-f]+\})|[^"\\\n\r])*")'
    r"|(?P<name>[A-Za-z_][A-Za-z0-9_]*)"
    r"|(?P<number>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![A-Za-z_0-9.]))"
    r"|(?P<punct>\.\.\.|[!$&()\[\]{}:=@|])"
)
_NEWLINE = re.compile(r"\r\n|\n|\r")


def position(text: str, at: int) -> tuple[int, int]:
    """Line and column of an offset, counted from 1."""
    line, begin = 1, 0
    for m in _NEWLINE.finditer(text, 0, at):
        line, begin = line + 1, m.end()
    return line, at - begin + 1


def tokens(text: str) -> list[Token]:
    """All tokens, with an ``end`` token last."""
    out, at = [], 0
    while True:
        at = _IGNORED.match(text, at).end()
        if at >= len(text):
            out.append(Token("end", "<EOF>", at, at))
            return out
        m = _TOKEN.match(text, at)
        if m is None:
            what = "Unterminated string" if text[at] == '"' else f"Unexpected character: {text[at]!r}"
            raise SyntaxProblem(f"Syntax Error: {what}.", *position(text, at))
        out.append(Token(m.lastgroup, m.group(), at, m.end()))
        at = m.end()


def block_value(raw: str) -> str:
    """Value of a block string literal: common indent and blank edges removed."""
    lines = _NEWLINE.split(raw[3:-3].replace('\\"""', '"""'))
    indents = [len(x) - len(x.lstrip(" \t")) for x in lines[1:] if x.strip(" \t")]
    cut = min(indents, default=0)
    lines = [lines[0], *(x[cut:] for x in lines[1:])]
    while lines and not lines[0].strip(" \t"):
        lines.pop(0)
    while lines and not lines[-1].strip(" \t"):
        lines.pop()
    return "\n".join(lines)


def minimal_block(value: str) -> str:
    """Shortest block string literal with this value."""
    lines = value.split("\n")
    lead = "\n" if len(lines) > 1 and all(not x or x[0] in " \t" for x in lines[1:]) else ""
    ends_quote = value.endswith('"') and not value.endswith('"""')
    trail = "\n" if ends_quote or value.endswith("\\") else ""
    return '"""' + lead + value.replace('"""', '\\"""') + trail + '"""'


_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", '"': '"', "\\": "\\", "/": "/"}


def string_value(t: Token) -> str:
    if t.kind == "block":
        return block_value(t.text)
    return re.sub(r"\\(?:u\{([0-9A-Fa-f]+)\}|u([0-9A-Fa-f]{4})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES[m[3]], t.text[1:-1])


def compact(text: str) -> str:
    """The text without ignored characters: one space where two words would touch, minimal block strings."""
    out: list[str] = []
    word_before = False
    for t in tokens(text)[:-1]:
        word = t.kind != "punct"
        if word_before and (word or t.text == "..."):
            out.append(" ")
        out.append(minimal_block(block_value(t.text)) if t.kind == "block" else t.text)
        word_before = word
    return "".join(out)
