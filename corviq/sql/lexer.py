"""Tokens of the dialect. Text never reaches Spark's own parser: ``<=>`` means a distance here, null-safe equality there."""

from __future__ import annotations

import re
from dataclasses import dataclass

from corviq.errors import EngineError

MAX_TEXT, MAX_TOKENS = 1 << 20, 20_000

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<number>(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<name>[^\W\d]\w*)
    |"(?P<quoted>(?:[^"]|"")+)"
    |'(?P<string>(?:[^']|'')*)'
    |\$(?P<param>[1-9]\d*)
    |(?P<sign><=>|<=|>=|<>|!=|[-+*/%=<>(),.;\[\]])""",
    re.VERBOSE | re.DOTALL,
)


@dataclass(frozen=True)
class Token:
    """``kind``: name, quoted, string, number, param, sign or end; names are lower case unless quoted."""

    kind: str
    text: str
    at: int


def tokenize(sql: str) -> list[Token]:
    if len(sql.encode("utf-8", "surrogatepass")) > MAX_TEXT:
        raise EngineError("54000", "the statement is longer than 1 MiB")
    out: list[Token] = []
    at = 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if m is None:
            raise EngineError("42601", f"unexpected character at {at}")
        kind = m.lastgroup
        if kind != "space":
            text = m[kind]
            if kind == "string":
                text = text.replace("''", "'")
            elif kind == "quoted":
                text = text.replace('""', '"')
            elif kind == "name":
                text = text.lower()
            out.append(Token(kind, text, at))
            if len(out) > MAX_TOKENS:
                raise EngineError("54000", f"more than {MAX_TOKENS} tokens")
        at = m.end()
    out.append(Token("end", "", len(sql)))
    return out


def split(sql: str) -> list[str]:
    """The statements of a message, at most sixteen."""
    out, begin = [], 0
    for t in tokenize(sql):
        if t.kind == "end" or (t.kind, t.text) == ("sign", ";"):
            if sql[begin : t.at].strip():
                out.append(sql[begin : t.at].strip())
            begin = t.at + 1
    if len(out) > 16:
        raise EngineError("54000", "more than 16 statements")
    return out
