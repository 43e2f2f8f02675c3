"""A3, A4, E: ingest projection, label remap and deterministic feature engineering.

All row-wise projections: no shuffle, streaming-safe, codegen'd.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarefold.spec import DatasetSpec

# Failure-mode flags of the milling table and its one-hot categories.
FAILURE_MODES = ("twf", "hdf", "pwf", "osf", "rnf")
CATEGORIES = ("L", "M", "H")

# Raw UCI milling column names -> canonical names.
RENAME_MAP = {
    "Type": "type",
    "Air temperature [K]": "air_temperature_k",
    "Process temperature [K]": "process_temperature_k",
    "Rotational speed [rpm]": "rotational_speed_rpm",
    "Torque [Nm]": "torque_nm",
    "Tool wear [min]": "tool_wear_min",
    "Machine failure": "machine_failure",
    "TWF": "twf",
    "HDF": "hdf",
    "PWF": "pwf",
    "OSF": "osf",
    "RNF": "rnf",
}

CANONICAL = [
    "type", "air_temperature_k", "process_temperature_k", "rotational_speed_rpm", "torque_nm",
    "tool_wear_min", "machine_failure", "twf", "hdf", "pwf", "osf", "rnf",
]


def ingest_rename_project(features: DataFrame, targets: DataFrame, key: str = "row_id") -> DataFrame:
    """A3: glue features and targets by row key (the positional concat), rename, canonical order."""
    glued = features.join(targets, on=key, how="inner")
    renamed = glued.withColumnsRenamed({k: v for k, v in RENAME_MAP.items() if k in glued.columns})
    return renamed.select(key, *[c for c in CANONICAL if c in renamed.columns])


def label_remap(df: DataFrame, target: str) -> DataFrame:
    """A4/E5: 1 -> 'yes', 0 -> 'no', anything else -> null; only if the column exists."""
    if target not in df.columns:
        return df
    c = F.col(target)
    return df.withColumn(target, F.when(c == 1, F.lit("yes")).when(c == 0, F.lit("no")))


def engineer_milling(df: DataFrame) -> DataFrame:
    """Power, temperature delta, wear x torque, full one-hot of type, label remap."""
    out = df.withColumns(
        {
            "power_w": F.col("torque_nm") * F.col("rotational_speed_rpm") * (2 * math.pi) / 60.0,
            "temp_delta_k": F.col("process_temperature_k") - F.col("air_temperature_k"),
            "wear_x_torque": F.col("tool_wear_min") * F.col("torque_nm"),
            **{f"type_{c}": (F.col("type") == c).cast("int") for c in CATEGORIES},
        }
    )
    return label_remap(out, "machine_failure")


def feature_matrix(df: DataFrame, spec: DatasetSpec, key: str = "row_id") -> DataFrame:
    """(key, features..., label int) with the leak guard enforced."""
    leak = set(spec.features) & (set(spec.leaky) | {spec.target})
    if leak:
        raise ValueError(f"leaky columns in the feature set: {sorted(leak)}")
    y = (F.col(spec.target).cast("string") == spec.positive_label).cast("int")
    return df.select(key, *[F.col(f).cast("double").alias(f) for f in spec.features], y.alias("label"))


def mode_consistency(df: DataFrame, label: Column, modes: tuple[str, ...] = FAILURE_MODES) -> DataFrame:
    """Count per flag, rows with >= 1 / >= 2 modes, mode without label, label without mode."""
    k = sum((F.col(m).cast("int") for m in modes), F.lit(0))
    return df.select(label.alias("_y"), k.alias("_k"), *modes).agg(
        *[F.sum(F.col(m).cast("long")).alias(f"n_{m}") for m in modes],
        F.count_if(F.col("_k") >= 1).alias("rows_ge1_mode"),
        F.count_if(F.col("_k") >= 2).alias("rows_ge2_modes"),
        F.count_if((F.col("_k") >= 1) & (F.col("_y") == 0)).alias("mode_without_label"),
        F.count_if((F.col("_k") == 0) & (F.col("_y") == 1)).alias("label_without_mode"),
    )


def feature_by_mode(df: DataFrame, feature: str, modes: tuple[str, ...] = FAILURE_MODES) -> DataFrame:
    """Per failure-mode flag value: n, mean, sd, min, max of a derived feature."""
    long = df.select(F.col(feature).cast("double").alias("v"), *[F.col(m).cast("int").alias(m) for m in modes]).unpivot(
        ["v"], list(modes), "mode", "flag"
    )
    return long.groupBy("mode", "flag").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("min"), F.max("v").alias("max")
    )


def milling_view(obs: DataFrame) -> DataFrame:
    """Bind lineitem observations to the milling-machine schema (needs ``extra=True`` columns).

    Fixed binding: type from returnflag (A/N/R -> L/M/H); air = 295 + 100*tax; process = 305 + 100*disc;
    rpm = floor(extendedprice / 10); torque = qty; wear = suppkey mod 250; flags from the rules
    used for the label.
    """
    q, d, t = F.col("qty"), F.col("disc"), F.col("tax")
    return obs.select(
        "row_id",
        F.when(F.col("returnflag") == "A", "L").when(F.col("returnflag") == "N", "M").otherwise("H").alias("type"),
        (F.lit(295.0) + 100.0 * t).alias("air_temperature_k"),
        (F.lit(305.0) + 100.0 * d).alias("process_temperature_k"),
        F.floor(F.col("extprice") / 10.0).cast("long").alias("rotational_speed_rpm"),
        q.alias("torque_nm"),
        (F.col("suppkey") % 250).cast("long").alias("tool_wear_min"),
        (F.col("failure") == "yes").cast("long").alias("machine_failure"),
        (q >= 41).cast("long").alias("twf"),
        (d >= 0.05).cast("long").alias("hdf"),
        (F.col("returnflag") == "R").cast("long").alias("pwf"),
        (F.col("line") == 7).cast("long").alias("osf"),
        ((F.col("linestatus") == "F") & (F.col("line") == 1) & (q <= 2)).cast("long").alias("rnf"),
    )
