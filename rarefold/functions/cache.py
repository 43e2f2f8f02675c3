"""Explicit reuse of intermediate tables within one query.

A DataFrame plan is a tree: a table referenced by several branches (the scored
table feeding confusion, AP and AUC; a kernel input read by two branches) is
recomputed per branch unless it is materialised once.  ``keep`` persists it
(memory, spilling to disk -- recomputed from lineage if an executor is lost) and
registers it; ``release`` unpersists everything kept since the last call.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

_KEPT: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _KEPT.append(df)
    return df


def release() -> None:
    while _KEPT:
        _KEPT.pop().unpersist()
