"""Streaming faces of the library, beyond the reference's scope: windows, sketches, rate limits and last-write merges."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.session import Scratch


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A Parquet file or folder as a stream, its schema taken from what is there."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if path.endswith(".parquet") and not os.path.isdir(path.removeprefix("file://")):
        folder, _, name = path.rpartition("/")  # a file source watches a folder
        reader = reader.option("pathGlobFilter", name)
        path = folder
    return reader.parquet(path)


def windowed_counts(stream: DataFrame, width: str, late: str, slide: str | None = None) -> DataFrame:
    """``start, event_type, n, total`` per tumbling or sliding window; events later than ``late`` are dropped."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counts = timed.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def windowed_distinct(stream: DataFrame, width: str, late: str, value: str) -> DataFrame:
    """``start, sketch``: a HyperLogLog sketch per window, to be merged over windows later."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w")).agg(F.hll_sketch_agg(value).alias("sketch")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "sketch")


def sessions(stream: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """``key, start, end, n`` per session, closed by a gap."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    found = timed.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


def rate_limited(stream: DataFrame, key: str, tick: str, capacity: float, per_tick: float) -> DataFrame:
    """``key, tick, allowed``: a token bucket per key, its level kept as state between batches."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, at = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(batches)).sort_values(tick, kind="stable")
        allowed = []
        for t in rows[tick]:
            level = min(capacity, level + (t - at) * per_tick) if at is not None and t > at else level
            at = t if at is None else max(at, t)
            allowed.append(level >= 1)
            level -= level >= 1
        state.update((float(level), int(at)))
        yield pd.DataFrame({key: rows[key], tick: rows[tick], "allowed": allowed})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, `{tick}` bigint, allowed boolean", "level double, at bigint", "append", GroupStateTimeout.NoTimeout)


def run_to_table(frame: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and give its result as a table in memory; for tests and small results."""
    name = f"stream_{uuid.uuid4().hex}"
    scratch = Scratch(frame.sparkSession, "stream")
    query = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", scratch.root).trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.table(name)


def latest_by_key(spark: SparkSession, stream: DataFrame, key: str, at: str, origin: str, value: str) -> DataFrame:
    """``key, at, origin, value`` of each key's last write, merged batch by batch into a table that is replaced whole."""
    scratch = Scratch(spark, "latest")
    pick = lambda df: df.groupBy(key).agg(F.max(F.struct(at, origin, value)).alias("w")).select(key, f"w.{at}", f"w.{origin}", f"w.{value}")
    held: dict[str, DataFrame] = {}

    def merge(batch: DataFrame, n: int) -> None:
        new = pick(batch.select(key, at, origin, value))
        held["now"] = scratch.write(f"batch{n}", pick(held["now"].unionByName(new)) if "now" in held else new)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{scratch.root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return held["now"] if "now" in held else spark.createDataFrame([], stream.select(key, at, origin, value).schema)
