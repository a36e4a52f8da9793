"""Generated memory tables for load tests: tenants with clustered vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def memory_corpus(spark: SparkSession, tenants: int = 8, per_tenant: int = 500, width: int = 16, clusters: int = 5, noise: float = 0.15, seed: int = 1) -> DataFrame:
    """``id, tenant, fact, embedding``: vectors around ``clusters`` centres per tenant.

    Every value is a function of the row's number and the seed, so a corpus of
    any size is made where it is used, the same every time.
    """
    unit = lambda *key: (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    bell = lambda *key: sum((unit(*key, F.lit(i)) for i in range(4)), F.lit(-2.0)) * (3**0.5)  # noqa: E731  near to normal
    rows = spark.range(tenants * per_tenant).select("id", F.pmod("id", F.lit(tenants)).alias("t"))
    rows = rows.withColumn("c", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(clusters)))
    parts = [(bell(F.col("t"), F.col("c"), F.lit(j)) + bell(F.col("id"), F.lit(j), F.lit("n")) * noise).cast("float") for j in range(width)]
    return rows.select(
        "id", F.format_string("tenant-%03d", "t").alias("tenant"), F.format_string("fact %d of cluster %d", "id", "c").alias("fact"), F.array(*parts).alias("embedding")
    )
