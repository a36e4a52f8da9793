"""Dense positions in a global order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import Scratch


def dense_positions(frame: DataFrame, order: list[str], name: str = "position", scratch: Scratch | None = None) -> DataFrame:
    """``frame`` with the 0-based position of each row in ``order``.

    Rows are range-partitioned and written; the sizes of the partitions, one
    row each, give the offset of every partition. ``order`` should tell all
    rows apart: ties get positions of no fixed order. Columns whose names begin
    with ``_tidemark`` must not be there.
    """
    scratch = scratch or Scratch(frame.sparkSession, "positions")
    ranged = frame.repartitionByRange(*order).withColumn("_tidemark_part", F.spark_partition_id())
    held = scratch.write("ranged", ranged)
    sizes = held.groupBy("_tidemark_part").count().orderBy("_tidemark_part").collect()
    offsets, total = [], 0
    for r in sizes:
        offsets.append((r[0], total))
        total += r[1]
    table = frame.sparkSession.createDataFrame(offsets or [(0, 0)], "_tidemark_part int, _tidemark_offset bigint")
    own = F.row_number().over(Window.partitionBy("_tidemark_part").orderBy(*order))
    out = held.withColumn(name, own - 1).join(F.broadcast(table), "_tidemark_part")
    return out.withColumn(name, (F.col(name) + F.col("_tidemark_offset")).cast("bigint")).drop("_tidemark_part", "_tidemark_offset")
