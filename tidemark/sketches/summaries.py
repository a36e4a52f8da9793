"""Mergeable summaries: each is an aggregation that combines before it shuffles, so no heavy key gathers its rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_bits(column: str | Column, seed: str, bits: int = 60) -> Column:
    """``bits`` (a multiple of 4, at most 60) of SHA-256 over the text of a value, as a whole number; null for null."""
    c = F.col(column) if isinstance(column, str) else column
    text = F.concat(F.lit(seed + ":"), c.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, bits // 4), 16, 10).cast("bigint")


# distinct counts
def hll_build(frame: DataFrame, keys: list[str], value: str, precision: int = 14) -> DataFrame:
    """One HyperLogLog sketch of ``value`` per key, 2**precision registers; nulls don't count."""
    return frame.groupBy(*keys).agg(F.hll_sketch_agg(value, precision).alias("sketch"))


def hll_merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def hll_estimate(sketches: DataFrame) -> DataFrame:
    return sketches.withColumn("estimate", F.hll_sketch_estimate("sketch")).drop("sketch")


# counts
class CountMin:
    """Counts of values in ``depth`` rows of ``width`` cells. An estimate is never too low, and above by at most
    ``epsilon`` times all counts but for a chance of ``delta``."""

    def __init__(self, epsilon: float = 0.001, delta: float = 0.01):
        self.width, self.depth = math.ceil(math.e / epsilon), math.ceil(math.log(1 / delta))

    def cells(self, value: str) -> Column:
        return F.array(*(F.struct(F.lit(i).alias("row"), F.pmod(hash_bits(value, f"cm{i}"), F.lit(self.width)).alias("cell")) for i in range(self.depth)))

    def build(self, frame: DataFrame, value: str) -> DataFrame:
        """``row, cell, n``: at most depth x width rows. Values are counted before they are spread over the rows."""
        counted = frame.filter(F.col(value).isNotNull()).groupBy(value).count()
        return counted.select(F.explode(self.cells(value)).alias("c"), "count").groupBy("c.row", "c.cell").agg(F.sum("count").alias("n"))

    @staticmethod
    def merge(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.unionByName(b).groupBy("row", "cell").agg(F.sum("n").alias("n"))

    def estimate(self, sketch: DataFrame, values: DataFrame, value: str) -> DataFrame:
        """``value, estimate`` of the distinct ``values``; what was never seen has the least of its cells, mostly 0."""
        asked = values.select(value).filter(F.col(value).isNotNull()).distinct()
        spread = asked.select(value, F.explode(self.cells(value)).alias("c")).select(value, "c.row", "c.cell")
        found = spread.join(sketch, ["row", "cell"], "left")
        return found.groupBy(value).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


# membership
class Bloom:
    """Set bits of a Bloom filter as words of 60 bits; or counters for one that can forget."""

    def __init__(self, expected: int, error: float = 0.01):
        self.bits = max(60, math.ceil(-max(1, expected) * math.log(error) / math.log(2) ** 2))
        self.hashes = max(1, round(self.bits / max(1, expected) * math.log(2)))

    def positions(self, value: str) -> Column:
        """By double hashing: two hashes give all positions."""
        a, b = hash_bits(value, "bf1", 40), hash_bits(value, "bf2", 40)
        return F.array(*(F.pmod(a + F.lit(i) * (b * 2 + 1), F.lit(self.bits)) for i in range(self.hashes)))

    def build(self, frame: DataFrame, value: str) -> DataFrame:
        """``word, mask``."""
        at = frame.filter(F.col(value).isNotNull()).select(value).distinct().select(F.explode(self.positions(value)).alias("p"))
        return at.groupBy(F.floor(F.col("p") / 60).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 60 AS INT))")).alias("mask"))

    def probe(self, filter_: DataFrame, values: DataFrame, value: str) -> DataFrame:
        """``value, maybe`` of the distinct values: false is certain."""
        asked = values.select(value).filter(F.col(value).isNotNull()).distinct()
        at = asked.select(value, F.explode(self.positions(value)).alias("p")).withColumn("word", F.floor(F.col("p") / 60))
        hit = at.join(filter_, "word", "left").withColumn("set", F.coalesce(F.expr("(mask & shiftleft(1L, CAST(p % 60 AS INT))) <> 0"), F.lit(False)))
        return hit.groupBy(value).agg(F.min("set").alias("maybe"))

    def counters(self, added: DataFrame, removed: DataFrame, value: str) -> DataFrame:
        """``p, n``: a counting filter of what was added less what was removed."""
        plus = added.filter(F.col(value).isNotNull()).select(F.explode(self.positions(value)).alias("p"), F.lit(1).alias("n"))
        minus = removed.filter(F.col(value).isNotNull()).select(F.explode(self.positions(value)).alias("p"), F.lit(-1).alias("n"))
        return plus.union(minus).groupBy("p").agg(F.sum("n").alias("n")).filter("n > 0")

    def probe_counters(self, counters: DataFrame, values: DataFrame, value: str) -> DataFrame:
        asked = values.select(value).filter(F.col(value).isNotNull()).distinct()
        at = asked.select(value, F.explode(self.positions(value)).alias("p"))
        return at.join(counters, "p", "left").groupBy(value).agg((F.min(F.coalesce("n", F.lit(0))) > 0).alias("maybe"))


# frequent values
def heavy_hitters(frame: DataFrame, value: str, k: int, capacity: int = 256) -> DataFrame:
    """``value, n`` of the ``k`` most frequent values by a bounded summary of ``capacity`` counters; ties by value."""
    top = frame.agg(F.expr(f"approx_top_k(CAST(`{value}` AS STRING), {k}, {max(capacity, 2 * k)})").alias("t"))
    return top.select(F.explode("t").alias("x")).select(F.col("x.item").alias(value), F.col("x.count").alias("n"))


# quantiles
#: Buckets an octave is cut into; a value is within one part in SUB of its bucket's edges.
SUB = 16


def log_bucket(value: Column) -> Column:
    """The bucket of a positive number: its octave and the sixteenth of it."""
    octave = F.floor(F.log2(value))
    return (octave * SUB + F.least(F.floor((value / F.pow(F.lit(2.0), octave) - 1) * SUB), F.lit(SUB - 1))).cast("bigint")


def quantile_sketch(frame: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, bucket, n``; zero and negative values go to one lowest bucket. Merge by adding ``n``."""
    v = F.col(value).cast("double")
    bucket = F.when(v > 0, log_bucket(v)).otherwise(F.lit(-(1 << 40)))
    return frame.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def quantile_estimate(sketch: DataFrame, keys: list[str], q: float) -> DataFrame:
    """``keys, estimate``: the lower edge of the bucket that holds the ``q`` quantile. A key has few buckets whatever its rows."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    running = F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(w)
    placed = sketch.withColumn("upto", running).withColumn("rank", F.greatest(F.lit(1), F.ceil(total * q)))
    octave = F.floor(F.col("bucket") / SUB)
    edge = F.when(F.col("bucket") > -(1 << 40), F.pow(F.lit(2.0), octave) * (1 + (F.col("bucket") - octave * SUB) / SUB)).otherwise(0.0)
    return placed.filter("upto >= rank and upto - n < rank").select(*keys, edge.alias("estimate"))


# samples
def reservoir(frame: DataFrame, key: str, k: int, seed: str = "r") -> DataFrame:
    """``k`` rows drawn evenly by the order of their keys' hashes: the same rows every time, a top-k per task and one merge."""
    return frame.orderBy(F.sha2(F.concat(F.lit(seed + ":"), F.col(key).cast("string")), 256), key).limit(k)


# bitmaps
def bitmaps(frame: DataFrame, keys: list[str], number: str) -> DataFrame:
    """``keys, bucket, bitmap`` of sets of non-negative numbers, 32,768 to a bucket."""
    n = frame.filter(F.col(number) >= 0)
    return n.groupBy(*keys, F.bitmap_bucket_number(number).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bitmap"))


def bitmap_union(maps: DataFrame) -> DataFrame:
    return maps.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def bitmap_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("bucket", "bitmap").join(b.select("bucket"), "bucket", "left_semi").union(b.select("bucket", "bitmap").join(a.select("bucket"), "bucket", "left_semi"))
    return both.groupBy("bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"))


def bitmap_size(maps: DataFrame) -> DataFrame:
    return maps.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("size"))
