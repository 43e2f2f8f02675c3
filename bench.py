"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print ONE JSON line.

Each query is executed in full through Spark's ``noop`` sink (all partitions computed,
nothing collected to the driver), after one untimed warm-up of the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "contract_summary",
    "descriptive_table",
    "univariate_auc",
    "class_balance",
    "correlation_matrix",
    "plausibility_verdict",
    "stratified_folds",
    "foldwise_impute",
    "fold_metrics",
    "average_precision",
    "cost_curve",
    "optimal_threshold",
    "brier_decomposition",
    "zoo_logistic_balanced",
    "shap_importance",
    "dataset_comparison",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE

    from rarefold.functions.cache import release
    from rarefold.plans import catalog
    from rarefold.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    qs = catalog.queries()
    # warm-up (JVM, codegen caches) on the smallest table set, untimed
    warm = "/root/testdata/sf0.001" if os.path.isdir("/root/testdata/sf0.001") else sf_dir
    qs["contract_summary"](spark, warm).write.format("noop").mode("overwrite").save()
    release()

    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        release()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
