"""Bind the driver's tables to the observation-table model.

The driver tables carry no nulls, no impossible values and no rare label, so
the observation table is *derived* from ``lineitem`` by deterministic column
expressions (one projection, no shuffle; filters and column pruning reach the
parquet scan).  ``plans/oracle_base.py`` has the same derivation in SQL.

Fixed derivation values: null price when ``l_linenumber = 7 and l_discount = 0``;
label ``yes`` iff ``l_returnflag = 'R' and l_quantity >= 41 and l_discount >= 0.05``;
fixed score ``round(1 / (1 + exp(-(-5.5 + 0.08 * qty + 25 * disc))), 4)``.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rarefold.functions.partitioning import spread

LINEITEM_COLS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
    "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def row_key() -> Column:
    return F.md5(
        F.concat_ws(
            "|",
            F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"),
            F.round(F.col("l_extendedprice") * 100).cast("long"),
        )
    )


def failure_label() -> Column:
    return F.when(
        (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 41) & (F.col("l_discount") >= 0.05),
        F.lit("yes"),
    ).otherwise(F.lit("no"))


def observations(spark: SparkSession, sf_dir: str, extra: bool = False) -> DataFrame:
    """(row_id, qty, price, disc, tax, line, failure) [+ returnflag, linestatus if extra]."""
    li = spread(table(spark, sf_dir, "lineitem"), "l_orderkey")
    cols = [
        row_key().alias("row_id"),
        F.col("l_quantity").alias("qty"),
        F.when((F.col("l_linenumber") == 7) & (F.col("l_discount") == 0), F.lit(None).cast("double"))
        .otherwise(F.col("l_extendedprice"))
        .alias("price"),
        F.col("l_discount").alias("disc"),
        F.col("l_tax").alias("tax"),
        F.col("l_linenumber").cast("int").alias("line"),
        failure_label().alias("failure"),
    ]
    if extra:
        cols += [
            F.col("l_returnflag").alias("returnflag"),
            F.col("l_linestatus").alias("linestatus"),
            F.col("l_extendedprice").alias("extprice"),
            F.col("l_suppkey").alias("suppkey"),
        ]
    return li.select(*cols)


def fixed_score() -> Column:
    """The fixed scoring expression used to test the metric layer independently of training."""
    return F.round(1 / (1 + F.exp(-(F.lit(-5.5) + 0.08 * F.col("qty") + 25 * F.col("disc")))), 4)


def scored(obs: DataFrame, positive: str = "yes") -> DataFrame:
    """(row_id, y, score) of the valid rows under the fixed scoring expression."""
    return obs.select(
        "row_id",
        (F.col("failure") == positive).cast("int").alias("y"),
        fixed_score().alias("score"),
    )


def event_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second dataset: events, positive = event_type 'error'; attributes value, user_id, hour."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").cast("string").alias("row_id"),
        F.col("value"),
        F.col("user_id"),
        F.hour("ts").cast("int").alias("hour"),
        F.when(F.col("event_type") == "error", F.lit("yes")).otherwise(F.lit("no")).alias("failure"),
    )
