"""Partitioning helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str = "row_id") -> DataFrame:
    """Hash-repartition the *base* rows on ``key`` before a row-multiplying generator, but only
    when the input has fewer partitions than the cluster's parallelism (a single-row-group
    file gives one scan task).  On a large input this is a no-op.  Hash (not round-robin)
    keeps a recomputed partition identical after an executor loss."""
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target, key)
    return df
