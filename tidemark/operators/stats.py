"""Column statistics: distinct counts, bounds, most common values, equi-depth histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMON, BUCKETS = 32, 16
_COMMON = "array<struct<value:string,count:bigint>>"


def column_stats(frame: DataFrame, table: str) -> DataFrame:
    """One row per column: ``table_name, column_name, rows, nulls, distinct, low, high, common, histogram``.

    One pass of mergeable sketches over all rows. ``distinct`` is within 1 %
    or so; ``low``, ``high`` and ``histogram`` (16 equi-depth bounds) are of
    whole-number columns only; ``common`` are up to 32 frequent values with
    their counts, exact while few values occur, and null for vectors.
    """
    aggs = [F.count("*").alias("rows")]
    kinds = {}
    for i, f in enumerate(frame.schema):
        c = F.col(f"`{f.name}`")
        key = c.cast("string") if isinstance(f.dataType, T.BooleanType) else F.xxhash64(c) if isinstance(f.dataType, T.ArrayType) else c
        whole = isinstance(f.dataType, T.IntegralType)
        kinds[f.name] = whole
        aggs += [
            F.sum(c.isNull().cast("bigint")).alias(f"nulls{i}"),
            F.approx_count_distinct(key, 0.01).alias(f"distinct{i}"),
        ]
        if not isinstance(f.dataType, T.ArrayType):
            aggs.append(F.expr(f"approx_top_k(CAST(`{f.name}` AS STRING), {COMMON}, 4096)").alias(f"common{i}"))
        if whole:
            marks = [b / BUCKETS for b in range(BUCKETS + 1)]
            aggs += [F.min(c).alias(f"low{i}"), F.max(c).alias(f"high{i}"), F.percentile_approx(c, marks, 1024).alias(f"histogram{i}")]
    one = frame.agg(*aggs)
    rows = []
    for i, f in enumerate(frame.schema):
        none = F.lit(None).cast("bigint")
        rows.append(
            F.struct(
                F.lit(table).alias("table_name"), F.lit(f.name).alias("column_name"), F.col("rows"), F.coalesce(f"nulls{i}", F.lit(0)).alias("nulls"), F.col(f"distinct{i}").alias("distinct"),
                (F.col(f"low{i}").cast("bigint") if kinds[f.name] else none).alias("low"), (F.col(f"high{i}").cast("bigint") if kinds[f.name] else none).alias("high"),
                (F.lit(None).cast(_COMMON) if isinstance(f.dataType, T.ArrayType) else F.transform(f"common{i}", lambda x: F.struct(x["item"].alias("value"), x["count"].alias("count"))).cast(_COMMON)).alias("common"),
                (F.col(f"histogram{i}").cast("array<bigint>") if kinds[f.name] else F.lit(None).cast("array<bigint>")).alias("histogram"),
            )
        )
    return one.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
