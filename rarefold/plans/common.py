"""Shared pieces of the registered queries: the bound observation table and result hygiene."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rarefold.operators import contract
from rarefold.sources import bindings
from rarefold.spec import OBS


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (oracle hygiene: engines differ in the last ulp)."""
    return df.select(
        *[
            F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def obs(spark: SparkSession, sf: str, extra: bool = False) -> DataFrame:
    return bindings.observations(spark, sf, extra=extra)


def tagged(spark: SparkSession, sf: str, extra: bool = False) -> DataFrame:
    return contract.tag(obs(spark, sf, extra), OBS)


def valid(spark: SparkSession, sf: str, extra: bool = False) -> DataFrame:
    v, _ = contract.split(obs(spark, sf, extra), OBS)
    return v


def y_col(spec=OBS):
    return (F.col(spec.target) == spec.positive_label).cast("int")
