import datetime as dt
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators.treeagg import large_tenants, memory_stats, rounds_for, tree_aggregate

SCHEMA = "id long, tenant string, fact string, created_at timestamp_ntz, ingested_at timestamp_ntz, memories string"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_rounds_are_logarithmic():
    assert [rounds_for(n, 16) for n in (1, 16, 17, 256, 257, 4097)] == [1, 1, 2, 2, 3, 4]


@pytest.mark.parametrize("chunk_bits, fan_in, total", [(2, 2, 500), (14, 16, 500), (3, 4, 1)])
def test_a_hot_key_and_null_keys(spark, chunk_bits, fan_in, total):
    """Results don't depend on chunks, fan-in or the estimate of rows."""
    rows = [("hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 50}", i if i % 11 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(5)
    got = tree_aggregate(df, {"k": F.col("k")}, {"n": ("count", F.lit(1)), "c": ("count", F.col("v")), "s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}, total, chunk_bits, fan_in)
    want = defaultdict(list)
    for k, v in rows:
        want[k].append(v)
    for r in got.collect():
        vs = [v for v in want.pop(r["k"]) if v is not None]
        assert r["c"] == len(vs) and r["s"] == (sum(vs) if vs else None) and (r["lo"], r["hi"]) == ((min(vs), max(vs)) if vs else (None, None))
    assert not want


def test_plan_has_no_reducer_of_all_partials(spark):
    df = spark.range(100_000).selectExpr("id", "'one' k")
    got = tree_aggregate(df, {"k": F.col("k")}, {"n": ("count", F.lit(1))}, 100_000, 8, 4)
    assert [tuple(r) for r in got.collect()] == [("one", 100_000)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 + rounds_for(100_000 >> 8, 4)


def test_memories_count_once(spark):
    rows = [
        (1, " A ", "x", day(0), day(1), "c"), (1, "a", "x", day(0), day(9), "c"), (2, "a", " ", day(3), day(3), "c"), (3, None, "y", day(1), day(1), "c"), (4, "  ", None, None, None, "c"), (None, "a", "z", day(1), day(1), "c"),
        (5, "b\t", "q", None, day(2), "c"),
    ]
    got = {r["tenant"]: r for r in memory_stats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {t: r["memories"] for t, r in got.items()} == {"a": 2, None: 2, "b": 1}
    assert got["a"]["with_fact"] == 1 and got["a"]["latest_created"] == day(3) and got["a"]["latest_ingested"] == day(3)
    assert got["b"]["first_created"] is None


def test_share_is_of_all_memories(spark):
    rows = [(i, "a" if i < 2 else None if i < 50 else f"t{i}", "f", day(0), day(0), "") for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r[0] for r in large_tenants(df).collect()] == ["a"]
    assert large_tenants(df, 0.03).count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert memory_stats(df).count() == 0 and large_tenants(df).count() == 0
