"""The scalar functions of the dialect, each as a Spark SQL fragment.

A null argument gives null but for CONCAT, NULLIF, GREATEST, LEAST and
COALESCE. Where Spark's function of the same name differs, the fragment
restates the dialect's meaning.
"""

from __future__ import annotations

from collections.abc import Callable

from tidemark.functions.casts import as_text, trimmed
from tidemark.functions.typed import NUMERIC, Typed
from tidemark.functions import vector
from tidemark.plans.lexer import SqlError

Rule = Callable[[list[Typed]], Typed]


def _number(x: Typed, function: str) -> None:
    if x.type not in ("int", "float", "null"):
        raise SqlError(f"{function} takes INT or FLOAT, not {x.type}")


def _text(f: str) -> Rule:
    return lambda a: Typed(f.format(*(as_text(x) for x in a)), "text")


def _kept(f: str, function: str) -> Rule:
    """INT stays INT and FLOAT stays FLOAT."""

    def rule(a: list[Typed]) -> Typed:
        _number(a[0], function)
        kind = "int" if a[0].type == "int" else "float"
        return Typed(f"CAST({f.format(a[0].sql)} AS {'BIGINT' if kind == 'int' else 'DOUBLE'})", kind)

    return rule


def _float(f: str) -> Rule:
    return lambda a: Typed(f.format(*(f"CAST({x.sql} AS DOUBLE)" for x in a)), "float")


def _initcap(a: list[Typed]) -> Typed:
    s = as_text(a[0])
    word = "concat(upper(substr(w, 1, 1)), lower(substr(w, 2)))"
    return Typed(f"array_join(transform(regexp_extract_all({s}, '(?U)(\\\\s+|\\\\S+)', 1), w -> {word}), '')", "text")


def _substr(a: list[Typed]) -> Typed:
    start = f"CAST(greatest({a[1].sql}, 1L) AS INT)"
    size = f"CAST(least(greatest({a[2].sql}, 0L), 2147483647L) AS INT)" if len(a) > 2 else "2147483647"
    guard = " OR ".join(f"{x.sql} IS NULL" for x in a[1:])
    return Typed(f"CASE WHEN {guard} THEN NULL ELSE substring({as_text(a[0])}, {start}, {size}) END", "text")


def _replace(a: list[Typed]) -> Typed:
    s, old, new = (as_text(x) for x in a)
    between = f"concat({new}, array_join(split({s}, ''), {new}), {new})"
    return Typed(f"CASE WHEN {old} = '' THEN CASE WHEN {s} = '' THEN {new} ELSE {between} END ELSE replace({s}, {old}, {new}) END", "text")


def _round(a: list[Typed]) -> Typed:
    _number(a[0], "ROUND")
    if a[0].type == "int":
        return a[0]
    if len(a) == 1:
        return Typed(f"round({a[0].sql}, 0)", "float")
    # the figures after the point may be a column, which Spark's round doesn't take
    scale = f"pow(10D, {a[1].sql})"
    return Typed(f"(sign({a[0].sql}) * floor(abs({a[0].sql}) * {scale} + 0.5D) / {scale})", "float")


def _trunc(a: list[Typed]) -> Typed:
    _number(a[0], "TRUNC")
    if a[0].type == "int":
        return a[0]
    scale = f"pow(10D, {a[1].sql})" if len(a) > 1 else "1D"
    return Typed(f"(sign({a[0].sql}) * floor(abs({a[0].sql}) * {scale}) / {scale})", "float")


def _mod(a: list[Typed]) -> Typed:
    if any(x.type not in ("int", "null") for x in a):
        raise SqlError("MOD takes INT")
    return Typed(f"({a[0].sql} % {a[1].sql})", "int")


def _ln(a: list[Typed]) -> Typed:
    x = f"CAST({a[0].sql} AS DOUBLE)"
    return Typed(f"CASE WHEN {x} < 0 THEN CAST('NaN' AS DOUBLE) WHEN {x} = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE ln({x}) END", "float")


def _log(a: list[Typed]) -> Typed:
    if len(a) == 1:
        x = f"CAST({a[0].sql} AS DOUBLE)"
        return Typed(f"CASE WHEN {x} < 0 THEN CAST('NaN' AS DOUBLE) WHEN {x} = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE log10({x}) END", "float")
    return Typed(f"(({_ln([a[1]]).sql}) / ({_ln([a[0]]).sql}))", "float")


def common(kinds: list[Typed]) -> tuple[str, int]:
    """The one type of several values, the numbers widened."""
    known = [k for k in kinds if k.type != "null"]
    if not known:
        return "null", 0
    types = {k.type for k in known}
    if types <= set(NUMERIC):
        kind = "float" if "float" in types else "decimal" if "decimal" in types else "int"
        return kind, max(k.scale for k in known)
    if len(types) > 1:
        if types == {"text", "json"}:
            return "text", 0
        raise SqlError(f"{' and '.join(sorted(types))} don't mix")
    return known[0].type, known[0].scale


def _same(f: str) -> Rule:
    def rule(a: list[Typed]) -> Typed:
        kind, scale = common(a)
        return Typed(f"{f}({', '.join(x.sql for x in a)})" if len(a) > 1 else a[0].sql, kind, scale)

    return rule


#: The parts of a date or time that are read.
PARTS = ("year", "month", "day", "hour", "minute", "second", "dow", "doy")


def _date_part(a: list[Typed]) -> Typed:
    part = a[0].sql.strip("'").lower()
    if part not in PARTS:
        raise SqlError(f"unknown field {part}")
    if a[1].type not in ("date", "timestamp", "null"):
        raise SqlError("DATE_PART takes DATE or TIMESTAMP")
    t = a[1].sql
    if part == "dow":
        return Typed(f"CAST(dayofweek({t}) - 1 AS BIGINT)", "int")
    if part in ("hour", "minute", "second"):
        t = f"CAST({t} AS TIMESTAMP_NTZ)"
    return Typed(f"CAST(date_part('{part}', {t}) AS BIGINT)" if part != "second" else f"CAST(floor(date_part('second', {t})) AS BIGINT)", "int")


def _date_trunc(a: list[Typed]) -> Typed:
    part = a[0].sql.strip("'").lower()
    if part not in PARTS[:6]:
        raise SqlError(f"unknown field {part}")
    return Typed(f"CAST(date_trunc('{part}', CAST({a[1].sql} AS TIMESTAMP_NTZ)) AS TIMESTAMP_NTZ)", "timestamp")


def _sign(a: list[Typed]) -> Typed:
    return _kept("signum({0})", "SIGN")(a)


FUNCTIONS: dict[str, tuple[range, Rule]] = {
    "length": (range(1, 2), lambda a: Typed(f"CAST(char_length({as_text(a[0])}) AS BIGINT)", "int")),
    "upper": (range(1, 2), _text("upper({0})")),
    "lower": (range(1, 2), _text("lower({0})")),
    "initcap": (range(1, 2), _initcap),
    "trim": (range(1, 2), lambda a: Typed(trimmed(as_text(a[0])), "text")),
    "ltrim": (range(1, 2), _text("regexp_replace({0}, '(?U)^\\\\s+', '')")),
    "rtrim": (range(1, 2), _text("regexp_replace({0}, '(?U)\\\\s+$', '')")),
    "substr": (range(2, 4), _substr),
    "substring": (range(2, 4), _substr),
    "right": (range(2, 3), lambda a: Typed(f"right({as_text(a[0])}, CAST(greatest({a[1].sql}, 0L) AS INT))" if a[1].type != "null" else "CAST(NULL AS STRING)", "text")),
    "repeat": (range(2, 3), lambda a: Typed(f"repeat({as_text(a[0])}, CAST({a[1].sql} AS INT))", "text")),
    "reverse": (range(1, 2), _text("reverse({0})")),
    "replace": (range(3, 4), _replace),
    "strpos": (range(2, 3), lambda a: Typed(f"CAST(instr({as_text(a[0])}, {as_text(a[1])}) AS BIGINT)", "int")),
    "position": (range(2, 3), lambda a: Typed(f"CAST(instr({as_text(a[0])}, {as_text(a[1])}) AS BIGINT)", "int")),
    "concat": (range(1, 999), lambda a: Typed(f"concat_ws('', {', '.join(as_text(x) for x in a)})", "text")),
    "abs": (range(1, 2), _kept("abs({0})", "ABS")),
    "sign": (range(1, 2), _sign),
    "mod": (range(2, 3), _mod),
    "round": (range(1, 3), _round),
    "trunc": (range(1, 3), _trunc),
    "truncate": (range(1, 3), _trunc),
    "floor": (range(1, 2), _kept("floor({0})", "FLOOR")),
    "ceil": (range(1, 2), _kept("ceil({0})", "CEIL")),
    "ceiling": (range(1, 2), _kept("ceil({0})", "CEIL")),
    "power": (range(2, 3), _float("pow({0}, {1})")),
    "pow": (range(2, 3), _float("pow({0}, {1})")),
    "sqrt": (range(1, 2), _float("sqrt({0})")),
    "exp": (range(1, 2), _float("exp({0})")),
    "ln": (range(1, 2), _ln),
    "log": (range(1, 3), _log),
    "coalesce": (range(1, 999), _same("coalesce")),
    "greatest": (range(1, 999), _same("greatest")),
    "least": (range(1, 999), _same("least")),
    "nullif": (range(2, 3), lambda a: Typed(f"nullif({a[0].sql}, {a[1].sql})", a[0].type, a[0].scale)),
    "date_part": (range(2, 3), _date_part),
    "date_trunc": (range(2, 3), _date_trunc),
    "vector_dims": (range(1, 2), lambda a: Typed(f"CAST(size({a[0].sql}) AS BIGINT)" if a[0].type != "null" else "CAST(NULL AS BIGINT)", "int")),
    "l2_norm": (range(1, 2), lambda a: Typed(vector.norm(a[0].sql), "float")),
    "l2_distance": (range(2, 3), lambda a: vector.distance("<->", *a)),
    "l1_distance": (range(2, 3), lambda a: vector.distance("<+>", *a)),
    "cosine_distance": (range(2, 3), lambda a: vector.distance("<=>", *a)),
    "inner_product": (range(2, 3), lambda a: vector.distance("dot", *a)),
}


def call(name: str, args: list[Typed]) -> Typed:
    if name not in FUNCTIONS:
        raise SqlError(f"unknown function {name}")
    count, rule = FUNCTIONS[name]
    if len(args) not in count:
        raise SqlError(f"{name} doesn't take {len(args)} arguments")
    return rule(args)
