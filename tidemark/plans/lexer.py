"""Tokens of the dialect."""

from __future__ import annotations

import re
from typing import NamedTuple


class SqlError(ValueError):
    """A statement that can't be read, bound or applied."""


class Token(NamedTuple):
    kind: str  # word, quoted, text, int, float, param, op, end
    text: str
    at: int


_TOKEN = re.compile(
    r"""(?P<skip>\s+|--[^\n]*)
      |(?P<float>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)
      |(?P<int>\d+)
      |(?P<text>'(?:[^']|'')*')
      |(?P<quoted>"(?:[^"]|"")+")
      |(?P<param>\$\d+)
      |(?P<word>[^\W\d]\w*)
      |(?P<op><=>|<->|<\#>|<\+>|->>|->|::|\|\||<=|>=|<>|!=|[-+*/<>=(),.;%\[\]])""",
    re.VERBOSE,
)


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise SqlError(f"unexpected character {sql[at]!r} at {at}")
        at = m.end()
        kind = m.lastgroup
        if kind == "skip":
            continue
        text = m[0]
        if kind == "text":
            text = text[1:-1].replace("''", "'")
        elif kind == "quoted":
            text = text[1:-1].replace('""', '"')
        out.append(Token(kind, text, m.start()))
    return [*out, Token("end", "", len(sql))]
