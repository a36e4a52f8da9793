"""Typed Spark SQL fragments: what an expression is spelled as and what type the dialect gives it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T


class Typed(NamedTuple):
    sql: str
    type: str  # int float bool text date timestamp json decimal vector null
    scale: int = 0


NUMERIC = ("int", "float", "decimal")
#: Scale of a DECIMAL column declared without one.
DECIMAL_SCALE = 6


def text_literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(s: str) -> str:
    return "`" + s.replace("`", "``") + "`"


def spark_type(kind: str, scale: int = DECIMAL_SCALE) -> str:
    return {
        "int": "BIGINT", "float": "DOUBLE", "bool": "BOOLEAN", "text": "STRING", "json": "STRING", "date": "DATE", "timestamp": "TIMESTAMP_NTZ",
        "decimal": f"DECIMAL(38, {scale})", "vector": "ARRAY<FLOAT>", "null": "VOID",
    }[kind]


def of_spark(kind: T.DataType) -> tuple[str, int]:
    """The dialect's type of a Spark column; what has none is read as text."""
    if isinstance(kind, T.DecimalType):
        return "decimal", kind.scale
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
        return "vector", 0
    for cls, word in (
        (T.IntegralType, "int"), (T.FractionalType, "float"), (T.BooleanType, "bool"), (T.DateType, "date"), (T.TimestampNTZType, "timestamp"), (T.TimestampType, "timestamp"), (T.NullType, "null"),
    ):
        if isinstance(kind, cls):
            return word, 0
    return "text", 0
