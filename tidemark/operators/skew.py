"""Joins and least values of groups of which one may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.treeagg import CHUNK_BITS, FAN_IN, rounds_for

#: A group with more than one in SHARE of all rows is hot; there are fewer than SHARE of them.
SHARE = 1_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], counts: DataFrame, total: int) -> DataFrame:
    """``rows`` joined to ``groups``, which has at most one row for each value of ``keys``.

    ``counts`` has ``keys`` and ``n``, the rows of each group, and ``total`` is
    their sum or more. Groups with more than one in SHARE of ``total`` are
    fewer than SHARE, and are broadcast; their rows stay where they are. The
    rest is joined by key, or by broadcast where Spark finds it small. Rows
    with a null key have no partner.
    """
    hot = counts.filter(F.col("n") * SHARE > total).select(*keys)
    if not hot.limit(1).count():
        return rows.join(groups, keys)
    hot = F.broadcast(hot)  # fewer than SHARE rows
    near = rows.join(F.broadcast(groups.join(hot, keys, "left_semi")), keys)
    return near.unionByName(rows.join(hot, keys, "left_anti").join(groups.join(hot, keys, "left_anti"), keys))


def least_of_group(rows: DataFrame, keys: list[str], value: str, carry: list[str], k: int, total: int, fan_in: int = FAN_IN) -> DataFrame:
    """Per group an array ``values`` of its ``k`` least distinct ``value``, ascending, and any one of each ``carry``.

    Groups are cut into lanes by hash of the value, of about as many rows as a
    chunk where one group holds all, and lanes are merged in rounds of fan-in ``fan_in``.
    """
    rounds = rounds_for(max(1, total >> CHUNK_BITS), fan_in)
    some = [F.any_value(c).alias(c) for c in carry]
    level = rows.withColumn("lane_", F.pmod(F.xxhash64(value), F.lit(fan_in**rounds)))
    level = level.groupBy(*keys, "lane_").agg(F.slice(F.sort_array(F.collect_set(value)), 1, k).alias("values"), *some)
    for _ in range(rounds):
        level = level.withColumn("lane_", F.floor(F.col("lane_") / fan_in)).groupBy(*keys, "lane_")
        level = level.agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("values")))), 1, k).alias("values"), *some)
    return level.drop("lane_")
