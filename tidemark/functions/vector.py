"""Distances of vectors as Spark SQL fragments; sums run in doubles over the single-precision components."""

from __future__ import annotations

from tidemark.functions.typed import Typed
from tidemark.plans.lexer import SqlError

_SUM = "aggregate({0}, 0D, (s, x) -> s + x)"


def _zip(a: str, b: str, f: str) -> str:
    return _SUM.format(f"zip_with({a}, {b}, (x, y) -> {f})")


def dot(a: str, b: str) -> str:
    return _zip(a, b, "CAST(x AS DOUBLE) * CAST(y AS DOUBLE)")


def norm(a: str) -> str:
    return f"sqrt(aggregate({a}, 0D, (s, x) -> s + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))"


def _vector(x: Typed) -> str:
    if x.type == "vector":
        return x.sql
    if x.type == "null":
        return "CAST(NULL AS ARRAY<FLOAT>)"
    if x.type in ("text", "json"):
        return f"from_json({x.sql}, 'array<float>', map('mode', 'FAILFAST'))"
    raise SqlError(f"a distance takes vectors, not {x.type}")


def distance(op: str, a: Typed, b: Typed) -> Typed:
    """``<->`` L2, ``<=>`` cosine, ``<#>`` negative inner product, ``<+>`` L1, ``dot`` inner product. Widths must agree.

    The cosine distance of two zero vectors is 0, of one zero vector and another 1.
    """
    x, y = _vector(a), _vector(b)
    if op == "<->":
        value = f"sqrt({_zip(x, y, '(CAST(x AS DOUBLE) - CAST(y AS DOUBLE)) * (CAST(x AS DOUBLE) - CAST(y AS DOUBLE))')})"
    elif op == "<+>":
        value = _zip(x, y, "abs(CAST(x AS DOUBLE) - CAST(y AS DOUBLE))")
    elif op == "<#>":
        value = f"(-{dot(x, y)})"
    elif op == "dot":
        value = dot(x, y)
    else:
        nx, ny = norm(x), norm(y)
        value = f"CASE WHEN {nx} = 0 AND {ny} = 0 THEN 0D WHEN {nx} = 0 OR {ny} = 0 THEN 1D ELSE 1D - {dot(x, y)} / ({nx} * {ny}) END"
    wrong = "CAST(raise_error('vectors of different width') AS DOUBLE)"
    return Typed(f"CASE WHEN {x} IS NULL OR {y} IS NULL THEN NULL WHEN size({x}) <> size({y}) THEN {wrong} ELSE {value} END", "float")
