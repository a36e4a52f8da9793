"""Conversions of the dialect. What can't be converted raises, by Spark's ANSI mode or ``raise_error``."""

from __future__ import annotations

from tidemark.functions.typed import Typed, spark_type, text_literal
from tidemark.plans.lexer import SqlError


def trimmed(sql: str) -> str:
    """Without outer white space of any kind, not only spaces."""
    return f"regexp_replace({sql}, '(?U)^\\\\s+|\\\\s+$', '')"


def float_text(sql: str) -> str:
    """A float in plain decimals: no exponent, no forced fraction."""
    plain = f"TRIM(TRAILING '.' FROM TRIM(TRAILING '0' FROM CAST(CAST(CAST({sql} AS STRING) AS DECIMAL(38, 18)) AS STRING)))"
    huge = f"cast(cast(cast({sql} AS STRING) AS DECIMAL(38, 0)) AS STRING)"
    whole = f"cast(cast({sql} AS BIGINT) AS STRING)"
    odd = f"CASE WHEN isnan({sql}) THEN 'NaN' WHEN {sql} > 0 THEN 'inf' ELSE '-inf' END"
    return (
        f"CASE WHEN {sql} IS NULL THEN NULL WHEN isnan({sql}) OR abs({sql}) >= 1e38D THEN {odd} "
        f"WHEN abs({sql}) < 1e15D AND {sql} = floor({sql}) THEN {whole} WHEN abs({sql}) >= 1e19D THEN {huge} ELSE {plain} END"
    )


def as_text(x: Typed) -> str:
    if x.type in ("text", "json"):
        return x.sql
    if x.type == "float":
        return float_text(x.sql)
    if x.type == "null":
        return "CAST(NULL AS STRING)"
    if x.type == "vector":
        return f"concat('[', array_join(transform({x.sql}, v -> {float_text('v')}), ','), ']')"
    return f"CAST({x.sql} AS STRING)"


def as_vector(x: Typed) -> str:
    if x.type == "vector":
        return x.sql
    return f"from_json({x.sql}, 'array<float>', map('mode', 'FAILFAST'))"


def cast(x: Typed, kind: str, args: tuple[int, ...] = ()) -> Typed:
    """``x`` as ``kind``: floats round to the nearest INT, half away from zero; text is trimmed and must fit."""
    sql, scale = x.sql, (args[1] if len(args) > 1 else 0)
    bad = SqlError(f"can't cast {x.type} to {kind}")
    if x.type == "null":
        return Typed(f"CAST(NULL AS {spark_type(kind, scale)})", kind, scale)
    if kind == x.type and kind != "decimal":
        return x
    if kind == "int":
        if x.type == "float":
            return Typed(f"CAST(round({sql}) AS BIGINT)", kind)
        if x.type == "decimal":
            return Typed(f"CAST(round({sql}, 0) AS BIGINT)", kind)
        if x.type == "bool":
            return Typed(f"CAST({sql} AS BIGINT)", kind)
        if x.type == "text":
            return Typed(f"CAST({trimmed(sql)} AS BIGINT)", kind)
        raise bad
    if kind == "float":
        if x.type in ("int", "decimal"):
            return Typed(f"CAST({sql} AS DOUBLE)", kind)
        if x.type == "text":
            return Typed(f"CAST({trimmed(sql)} AS DOUBLE)", kind)
        raise bad
    if kind == "bool":
        if x.type == "int":
            return Typed(f"({sql} <> 0)", kind)
        if x.type == "text":
            low = f"lower({trimmed(sql)})"
            wrong = f"CAST(raise_error(concat('not a boolean: ', {sql})) AS BOOLEAN)"
            return Typed(f"CASE WHEN {sql} IS NULL THEN NULL WHEN {low} IN ('true', 't', '1') THEN true WHEN {low} IN ('false', 'f', '0') THEN false ELSE {wrong} END", kind)
        raise bad
    if kind == "text":
        return Typed(as_text(x), kind)
    if kind == "date":
        if x.type == "timestamp":
            return Typed(f"CAST({sql} AS DATE)", kind)
        if x.type == "text":
            return Typed(f"CAST({trimmed(sql)} AS DATE)", kind)
        raise bad
    if kind == "timestamp":
        if x.type == "date":
            return Typed(f"CAST({sql} AS TIMESTAMP_NTZ)", kind)
        if x.type == "text":
            return Typed(f"CAST({trimmed(sql)} AS TIMESTAMP_NTZ)", kind)
        raise bad
    if kind == "json":
        if x.type == "text":
            return Typed(f"CASE WHEN {sql} IS NULL OR try_parse_json({sql}) IS NOT NULL THEN {sql} ELSE CAST(raise_error('not valid JSON') AS STRING) END", kind)
        raise bad
    if kind == "decimal":
        if x.type == "decimal" and not args:
            return x
        if x.type == "int":
            return Typed(f"CAST({sql} AS DECIMAL(38, {scale}))", kind, scale)
        if x.type in ("float", "text", "decimal"):
            scale = args[1] if len(args) > 1 else (0 if args else max(6, x.scale))
            inner = sql if x.type == "decimal" else trimmed(sql) if x.type == "text" else f"CAST({sql} AS STRING)"
            return Typed(f"CAST({inner} AS DECIMAL(38, {scale}))", kind, scale)
        raise bad
    if kind == "vector":
        if x.type in ("text", "json"):
            return Typed(as_vector(x), kind)
        raise bad
    raise SqlError(f"unknown type {kind}")


def literal(value, kind: str) -> Typed:
    if kind == "null":
        return Typed("NULL", "null")
    if kind == "int":
        if not -(2**63) <= value < 2**63:
            raise SqlError(f"whole number out of range: {value}")
        return Typed(f"{value}L", "int")
    if kind == "float":
        return Typed(f"CAST('{value}' AS DOUBLE)", "float")
    if kind == "bool":
        return Typed("true" if value else "false", "bool")
    text = text_literal(str(value))
    if kind == "text":
        return Typed(text, "text")
    if kind == "decimal":
        scale = len(str(value).strip().partition(".")[2])
        return Typed(f"CAST({text} AS DECIMAL({max(18, len(str(value)))}, {scale}))", "decimal", scale)
    return cast(Typed(text, "text"), kind)
