"""CSV in and out: quoted line breaks, doubled quotes, empty for null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.casts import as_text
from tidemark.functions.typed import Typed, name
from tidemark.plans.emit import Field
from tidemark.plans.lexer import SqlError


def read_csv(spark: SparkSession, path: str, columns: list[str], header: bool) -> DataFrame:
    """The rows of a CSV file or folder as text columns. A row of another number of fields is an error.

    Files with quoted line breaks can't be split; give many files, not one
    large one, for parallel reading.
    """
    schema = ", ".join(f"{name(c)} STRING" for c in columns)
    reader = spark.read.schema(schema).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").option("header", header)
    reader = reader.option("enforceSchema", True).option("nullValue", "").option("emptyValue", "")
    return reader.csv(path)


def write_csv(frame: DataFrame, fields: list[Field], path: str, header: bool, single: bool = True) -> int:
    """Write text forms of the columns and give back the number of rows; only fields that need quotes get them.

    ``single`` makes one part file, as a COPY does; without it every task
    writes its own.
    """
    if not fields:
        raise SqlError("a CSV needs columns")
    texts = frame.select(*(F.expr(as_text(Typed(name(f.name), f.type, f.scale))).alias(f.name) for f in fields))
    out = texts.coalesce(1) if single else texts
    out.write.mode("overwrite").option("header", header).option("escape", '"').option("emptyValue", "").option("nullValue", "").options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return frame.count()
