"""Declarative dataset specs: contract rules, targets, feature sets, costs, thresholds.

Plain frozen dataclasses passed as arguments; nothing here touches Spark
configuration.  Rule bounds are kept as Python literals so that Catalyst can
fold them and push range predicates into the parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


class ContractError(Exception):
    """Structural failure: a missing / extra column or a wrong type.  Nothing is quarantined."""


class QuarantineNotEmpty(Exception):
    """Raised by the quality gate when ``enforce=True`` and rows were quarantined."""

    def __init__(self, n: int):
        super().__init__(f"{n} rows quarantined")
        self.n = n


@dataclass(frozen=True)
class Rule:
    """One row-level check.  ``kind`` in {ge, le, gt, isin}."""

    kind: str
    value: object


@dataclass(frozen=True)
class Field:
    name: str
    dtype: T.DataType
    nullable: bool = False
    rules: tuple[Rule, ...] = ()


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    fields: tuple[Field, ...]
    target: str
    positive_label: str
    features: tuple[str, ...]
    leaky: tuple[str, ...] = ()
    simulated: bool = False
    key: str = "row_id"

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(name)

    def numeric_attributes(self) -> list[str]:
        """Numeric contract columns minus the target (booleans excluded)."""
        return [
            f.name
            for f in self.fields
            if isinstance(f.dtype, T.NumericType) and f.name != self.target
        ]

    def ranges(self) -> dict[str, tuple[float, float]]:
        """Closed physical ranges [lo, hi] of the columns that declare both bounds."""
        out = {}
        for f in self.fields:
            lo = next((r.value for r in f.rules if r.kind == "ge"), None)
            hi = next((r.value for r in f.rules if r.kind == "le"), None)
            if lo is not None and hi is not None:
                out[f.name] = (float(lo), float(hi))
        return out


@dataclass(frozen=True)
class QualityThresholds:
    # fixed values of the reference configuration
    min_prevalence: float = 0.01
    max_prevalence: float = 0.50
    max_null_pct_per_column: float = 0.10


@dataclass(frozen=True)
class CostMatrix:
    # fixed values of the reference configuration (CLP)
    tn: float = 0.0
    fp: float = 500_000.0
    fn: float = 10_000_000.0
    tp: float = 1_500_000.0

    def theoretical_threshold(self) -> float:
        c_fp = self.fp - self.tn
        c_fn = self.fn - self.tp
        return c_fp / (c_fp + c_fn)


@dataclass(frozen=True)
class CVScheme:
    n_splits: int = 5
    n_repeats: int = 1
    seed: int = 42


SEED = 42
COSTS = CostMatrix()
THRESHOLDS = QualityThresholds()

D = T.DoubleType()
L = T.LongType()
I = T.IntegerType()
S = T.StringType()

# Physical ranges of the lab sensor table.
LAB180 = DatasetSpec(
    name="lab180",
    fields=(
        Field("temperature_c", D, True, (Rule("ge", -273.15), Rule("le", 300.0))),
        Field("vibration_mm_s", D, True, (Rule("ge", 0.0), Rule("le", 100.0))),
        Field("pressure_bar", D, True, (Rule("ge", 0.0), Rule("le", 1000.0))),
        Field("hours_since_maintenance", L, False, (Rule("ge", 0.0), Rule("le", 100000.0))),
        Field("load_percent", D, False, (Rule("ge", 0.0), Rule("le", 100.0))),
        Field("failure", S, False, (Rule("isin", ("yes", "no")),)),
    ),
    target="failure",
    positive_label="yes",
    features=("temperature_c", "vibration_mm_s", "pressure_bar", "hours_since_maintenance", "load_percent"),
    simulated=True,
)

# Milling machine contract (Kelvin range 280-320, categories L/M/H, 0/1 flags).
AI4I2020 = DatasetSpec(
    name="ai4i2020",
    fields=(
        Field("type", S, False, (Rule("isin", ("L", "M", "H")),)),
        Field("air_temperature_k", D, False, (Rule("ge", 280.0), Rule("le", 320.0))),
        Field("process_temperature_k", D, False, (Rule("ge", 280.0), Rule("le", 320.0))),
        Field("rotational_speed_rpm", L, False, (Rule("gt", 0),)),
        Field("torque_nm", D, False, (Rule("ge", 0.0),)),
        Field("tool_wear_min", L, False, (Rule("ge", 0),)),
        Field("machine_failure", L, False, (Rule("isin", (0, 1)),)),
        Field("twf", L, False, (Rule("isin", (0, 1)),)),
        Field("hdf", L, False, (Rule("isin", (0, 1)),)),
        Field("pwf", L, False, (Rule("isin", (0, 1)),)),
        Field("osf", L, False, (Rule("isin", (0, 1)),)),
        Field("rnf", L, False, (Rule("isin", (0, 1)),)),
    ),
    target="machine_failure",
    positive_label="yes",
    features=(
        "air_temperature_k", "process_temperature_k", "rotational_speed_rpm", "torque_nm",
        "tool_wear_min", "power_w", "temp_delta_k", "wear_x_torque", "type_L", "type_M", "type_H",
    ),
    leaky=("machine_failure", "twf", "hdf", "pwf", "osf", "rnf"),
)

# Observation table derived from the driver's lineitem table (see sources.bindings).
OBS = DatasetSpec(
    name="lineitem_obs",
    fields=(
        Field("qty", D, False, (Rule("ge", 0.0), Rule("le", 49.0))),
        Field("price", D, True, (Rule("ge", 0.0),)),
        Field("disc", D, False, (Rule("ge", 0.0), Rule("le", 1.0))),
        Field("tax", D, False, (Rule("ge", 0.0), Rule("le", 1.0))),
        Field("line", I, False, (Rule("ge", 1.0), Rule("le", 7.0))),
        Field("failure", S, False, (Rule("isin", ("yes", "no")),)),
    ),
    target="failure",
    positive_label="yes",
    features=("qty", "price", "disc", "tax", "line"),
    leaky=("l_returnflag",),
)

# Second dataset for the cross-dataset comparison, derived from the events table.
EVENTS_OBS = DatasetSpec(
    name="events_obs",
    fields=(
        Field("value", D, False, (Rule("ge", 0.0),)),
        Field("user_id", L, False, (Rule("ge", 0.0),)),
        Field("hour", I, False, (Rule("ge", 0.0), Rule("le", 23.0))),
        Field("failure", S, False, (Rule("isin", ("yes", "no")),)),
    ),
    target="failure",
    positive_label="yes",
    features=("value", "user_id", "hour"),
)

REGISTRY: dict[str, DatasetSpec] = {s.name: s for s in (LAB180, AI4I2020, OBS, EVENTS_OBS)}


def get_spec(name: str) -> DatasetSpec:
    if name not in REGISTRY:
        raise KeyError(f"unknown dataset {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]
