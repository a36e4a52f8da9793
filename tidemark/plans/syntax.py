"""Syntax trees of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class Expr:
    pass


@dataclass(frozen=True)
class Lit(Expr):
    value: Any
    type: str  # int float text bool null date timestamp decimal vector


@dataclass(frozen=True)
class Param(Expr):
    n: int


@dataclass(frozen=True)
class Col(Expr):
    table: str | None
    name: str


@dataclass(frozen=True)
class Star(Expr):
    table: str | None = None


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    arg: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class IsNull(Expr):
    arg: Expr
    negated: bool


@dataclass(frozen=True)
class In(Expr):
    arg: Expr
    items: tuple[Expr, ...] | None
    query: "Query | None"
    negated: bool


@dataclass(frozen=True)
class Like(Expr):
    arg: Expr
    pattern: Expr
    negated: bool


@dataclass(frozen=True)
class Case(Expr):
    operand: Expr | None
    whens: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None


@dataclass(frozen=True)
class Cast(Expr):
    arg: Expr
    type: str
    args: tuple[int, ...] = ()


@dataclass(frozen=True)
class Over:
    partition: tuple[Expr, ...]
    order: tuple[tuple[Expr, bool], ...]


@dataclass(frozen=True)
class Func(Expr):
    name: str
    args: tuple[Expr, ...]
    distinct: bool = False
    over: Over | None = None


@dataclass(frozen=True)
class Exists(Expr):
    query: "Query"


@dataclass(frozen=True)
class Scalar(Expr):
    query: "Query"


@dataclass
class TableRef:
    name: str | None
    query: "Query | None"
    alias: str | None


@dataclass
class Join:
    kind: str  # inner left right full cross
    left: "TableRef | Join"
    right: "TableRef | Join"
    on: Expr | None = None
    using: list[str] | None = None
    natural: bool = False


@dataclass
class Select:
    items: list[tuple[Expr, str | None]]
    source: "TableRef | Join"
    where: Expr | None = None
    group: list[Expr] = field(default_factory=list)
    having: Expr | None = None
    distinct: bool = False


@dataclass
class SetOp:
    op: str
    all: bool
    left: "Select | SetOp"
    right: "Select | SetOp"


@dataclass
class Query:
    body: "Select | SetOp"
    order: list[tuple[Expr, bool, bool | None]] = field(default_factory=list)  # expression, descending, nulls first
    limit: int | None = None
    offset: int | None = None
    ctes: list[tuple[str, "Query"]] = field(default_factory=list)
    recursive: bool = False


@dataclass
class ColumnDef:
    name: str
    type: str
    args: tuple[int, ...] = ()
    primary: bool = False
    not_null: bool = False
    unique: bool = False
    default: str | None = None
    serial: bool = False
    check: str | None = None
    references: "ForeignKey | None" = None


@dataclass
class ForeignKey:
    column: str
    table: str
    target: str | None
    on_delete: str = "no action"
    on_update: str = "no action"


@dataclass
class Statement:
    """Any other statement: its kind and its parts."""

    kind: str
    parts: dict[str, Any]

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["parts"][name]
        except KeyError:
            raise AttributeError(name) from None
