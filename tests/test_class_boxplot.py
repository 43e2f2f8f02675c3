"""Boxplots by class against numpy; rows are not shuffled by (attribute, class), which are a handful of keys."""

import random

import numpy as np

from rarefold.operators import profile


def test_boxplot_equals_numpy_and_rows_stay_where_they_are(spark):
    rng = random.Random(3)
    rows = [(None if rng.random() < 0.1 else rng.gauss(0, 1) ** 3, float(rng.randint(0, 4)), rng.choice(["yes", "no", None])) for _ in range(500)] + [(None, 9.0, "alone")]
    df = spark.createDataFrame(rows, "a double, b double, failure string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # what Spark finds small by itself depends on sizes
    try:
        box = profile.class_boxplot(df, ["a", "b"], "failure")
        plan = box._jdf.queryExecution().executedPlan().toString()
        got = {(r["attr"], r["class"]): tuple(r)[2:] for r in box.collect()}
        table = profile.descriptive_table(df, ["a", "b"])
        medians = {r.attr: r.median for r in table.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    want = {}
    for i, a in enumerate("ab"):
        assert np.isclose(medians[a], np.median([r[i] for r in rows if r[i] is not None]))
        for c in ("yes", "no", "alone"):
            v = np.array([r[i] for r in rows if r[i] is not None and r[2] == c])
            if len(v):
                q1, q2, q3 = np.quantile(v, [0.25, 0.5, 0.75])
                lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
                want[a, c] = (q1, q2, q3, v[v >= lo].min(), v[v <= hi].max(), int(((v < lo) | (v > hi)).sum()))
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
