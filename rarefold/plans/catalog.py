"""All registered queries (name -> callable(spark, sf_dir)) and their DuckDB oracle SQL."""

from __future__ import annotations

import importlib

SECTIONS = [
    "rarefold.plans.q_contract",
    "rarefold.plans.q_profile",
    "rarefold.plans.q_audit",
    "rarefold.plans.q_resample",
    "rarefold.plans.q_metrics",
    "rarefold.plans.q_models",
    "rarefold.plans.q_explain",
    "rarefold.plans.q_io",
]


def _load():
    queries, oracle = {}, {}
    for mod_name in SECTIONS:
        mod = importlib.import_module(mod_name)
        for k, v in mod.QUERIES.items():
            if k in queries:
                raise ValueError(f"duplicate query {k}")
            queries[k] = v
        oracle.update(getattr(mod, "ORACLE", {}))
    missing = set(oracle) - set(queries)
    if missing:
        raise ValueError(f"oracle without query: {sorted(missing)}")
    return queries, oracle


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]
