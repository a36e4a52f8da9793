"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "memories tenants facts attr_catalog prices skus mix_targets"
).split()


def load(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table ``name`` under ``base``. Columns are pruned and filters pushed by Catalyst."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")
