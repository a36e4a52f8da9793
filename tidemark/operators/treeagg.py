"""Per-key aggregation that no heavy key can unbalance.

Rows are cut into fixed-size chunks where they lie. Every chunk combines its
rows into one state per key, and the states of a key are merged in rounds of
fan-in ``fan_in``. A reducer of any round receives at most ``fan_in`` states of
a key, so a key with a third of all rows costs no task more than a rare key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows a chunk holds, as a power of two.
CHUNK_BITS = 14
FAN_IN = 16

#: How a state column is built from rows and merged with others.
_MERGE: dict[str, tuple[Callable[[Column], Column], Callable[[str], Column]]] = {
    "count": (lambda c: F.count(c), F.sum),
    "sum": (lambda c: F.sum(c), F.sum),
    "min": (lambda c: F.min(c), F.min),
    "max": (lambda c: F.max(c), F.max),
}


def rounds_for(chunks: int, fan_in: int = FAN_IN) -> int:
    """Merge rounds until ``chunks`` lanes have become one: log of the chunks to base ``fan_in``."""
    n = 1
    while fan_in**n < chunks:
        n += 1
    return n


def tree_aggregate(
    frame: DataFrame,
    keys: dict[str, Column],
    states: dict[str, tuple[str, Column]],
    total_rows: int,
    chunk_bits: int = CHUNK_BITS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """One row per key with the merged ``states``.

    ``keys`` and ``states`` name the output columns; a state is a pair of one
    of count, sum, min, max and the column it is built from. ``total_rows``
    sets the number of rounds only; a wrong figure costs balance, not results.
    Null keys form one group, as in GROUP BY. An empty input gives no rows.
    States over only nulls are 0 for count and null for the others.
    """
    rounds = rounds_for(max(1, total_rows >> chunk_bits), fan_in)
    chunk = F.shiftright(F.monotonically_increasing_id(), chunk_bits)
    rows = frame.select(
        *(c.alias(f"k_{k}") for k, c in keys.items()),
        *(c.alias(f"s_{s}") for s, (_, c) in states.items()),
        chunk.alias("chunk"),
    )
    names = [f"k_{k}" for k in keys]
    level = rows.groupBy(*names, "chunk").agg(
        *(_MERGE[kind][0](F.col(f"s_{s}")).alias(f"s_{s}") for s, (kind, _) in states.items())
    )
    level = level.withColumn("lane", F.pmod(F.xxhash64("chunk"), F.lit(fan_in**rounds)))
    for _ in range(rounds):
        level = level.withColumn("lane", F.floor(F.col("lane") / fan_in)).groupBy(*names, "lane").agg(
            *(_MERGE[kind][1](f"s_{s}").alias(f"s_{s}") for s, (kind, _) in states.items())
        )
    return level.select(
        *(F.col(f"k_{k}").alias(k) for k in keys),
        *(F.col(f"s_{s}").alias(s) for s in states),
    )


def tenant_key(column: str = "tenant") -> Column:
    """``tenant`` trimmed of white space and lower-cased; null where nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", "")), F.lit(""))


def memory_stats(memories: DataFrame) -> DataFrame:
    """Per tenant: memories, those with a fact, first and latest ``created_at``, latest ``ingested_at``.

    All rows of one ``id`` are one memory; of its rows the earliest
    ``ingested_at`` counts. Rows whose ``id`` is null are no memories. The row
    with a null tenant holds the memories without one. Re-deliveries are
    removed by hash of the id, whose groups are small whatever the tenant.
    """
    rows = memories.filter(F.col("id").isNotNull())
    one = rows.groupBy("id").agg(
        F.min(tenant_key()).alias("tenant"),
        F.max(F.when(F.length(F.trim("fact")) > 0, 1).otherwise(0)).alias("has_fact"),
        F.min("created_at").alias("created_at"),
        F.min("ingested_at").alias("ingested_at"),
    )
    return tree_aggregate(
        one,
        {"tenant": F.col("tenant")},
        {
            "memories": ("count", F.lit(1)),
            "with_fact": ("sum", F.col("has_fact").cast("bigint")),
            "first_created": ("min", F.col("created_at")),
            "latest_created": ("max", F.col("created_at")),
            "latest_ingested": ("max", F.col("ingested_at")),
        },
        rows.count(),
    )


def large_tenants(memories: DataFrame, share: float = 0.02) -> DataFrame:
    """Tenants with at least ``share`` of all memories, those without tenant counted in the total.

    No memories give no rows. The comparison is exact, in whole numbers of
    memories per million of the share.
    """
    stats = memory_stats(memories).select("tenant", "memories")
    total = stats.agg(F.sum("memories").alias("total"))
    parts = round(share * 1_000_000)
    return (
        stats.join(F.broadcast(total))  # one row
        .filter(F.col("tenant").isNotNull() & (F.col("memories") * 1_000_000 >= F.col("total") * parts))
        .select("tenant")
    )
