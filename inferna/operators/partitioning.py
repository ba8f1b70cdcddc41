"""Partitioning helpers that adapt to the size of the input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-repartition a scan on ``keys`` only when it has fewer partitions
    than the cluster can run at once (e.g. one big single-row-group file).

    On a large multi-file input the scan already has thousands of splits and
    this is a no-op, so no extra shuffle is added at scale.  When it does
    repartition, it uses the shuffle-partition count so a following join or
    aggregation on the same keys reuses this exchange."""
    spark = df.sparkSession
    try:
        have = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - e.g. Spark Connect has no RDD view
        return df
    want = spark.sparkContext.defaultParallelism
    if have >= want:
        return df
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), want)
    return df.repartition(n, *keys) if keys else df.repartition(n)
