"""Registered queries, section H (model zoo), I9, J1, J5 (rows-only: iterative fits have no SQL oracle)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rarefold.functions.cache import keep
from rarefold.operators import decision, forest, linear, metrics, resample, zoo
from rarefold.plans.common import rounded, valid
from rarefold.plans.oracle_base import OBS as OBS_CTE
from rarefold.plans.oracle_base import TAGGED, VALID, with_
from rarefold.plans.q_resample import EXP, FE, FOLDS
from rarefold.spec import OBS as SPEC

K = 5
FEATS = list(SPEC.features)
GROUP = ["model", "rep", "fold"]


def model_folds(spark, sf, k=K):
    """Contract-valid rows with their stratified fold and rank, the base rows of every model query."""
    v = valid(spark, sf).withColumn("y", (F.col("failure") == "yes").cast("int"))
    return resample.stratified_folds(v, "failure", k=k, seed=42, keep_rank=True).select("row_id", "rep", "fold", "rank0", "y", *FEATS)


def base(spark, sf, k=K):
    return zoo.folded_base(model_folds(spark, sf, k), FEATS, k)


def _metrics(scored, flag="converged"):
    """Fold metrics, and whether every fit behind them converged (trees: whether one met a depth limit)."""
    if flag == "capped":  # trees are grown where their scores are read: once, not for each of the two readings
        scored = keep(scored.select(*GROUP, "y", "score", "pred", flag))
    fits = scored.groupBy(*GROUP).agg((F.bool_and if flag == "converged" else F.bool_or)(flag).alias(flag))
    return rounded(metrics.fold_metrics(scored, GROUP).join(fits, GROUP))


def q_zoo_logistic_plain(spark, sf):
    return _metrics(zoo.logistic_cv(base(spark, sf), balanced=False))


def q_zoo_logistic_balanced(spark, sf):
    return _metrics(zoo.logistic_cv(base(spark, sf), balanced=True))


def q_zoo_tree_default(spark, sf):
    return _metrics(forest.tree_cv(base(spark, sf), "tree_default", keys=False), "capped")


def q_zoo_tree_shallow(spark, sf):
    return _metrics(forest.tree_cv(base(spark, sf), "tree_shallow_balanced"), "capped")


def q_zoo_rf(spark, sf):
    return _metrics(forest.tree_cv(base(spark, sf), "rf_balanced", keys=False), "capped")


def q_zoo_gbt(spark, sf):
    return _metrics(forest.tree_cv(base(spark, sf), "gradient_boosting"), "capped")


def q_grid_search_c(spark, sf):
    return rounded(zoo.grid_search_c(base(spark, sf)))


def q_nested_cv(spark, sf):
    scored, bc = zoo.nested_cv(base(spark, sf))
    return rounded(metrics.fold_metrics(scored, GROUP).join(bc.withColumnRenamed("outer", "fold"), ["rep", "fold"]))


def q_calibrate_platt(spark, sf):
    return _metrics(zoo.platt_cv(base(spark, sf)))


def q_calibrate_isotonic(spark, sf):
    return _metrics(zoo.isotonic_cv(base(spark, sf)))


def q_oof_predictions(spark, sf):
    """Every row is scored exactly once out of fold."""
    s = zoo.logistic_cv(base(spark, sf), balanced=True)
    per_row = s.groupBy("model", "row_id").agg(F.count(F.lit(1)).alias("times"))
    return per_row.groupBy("model").agg(
        F.count(F.lit(1)).alias("rows_scored"), F.min("times").alias("min_times"), F.max("times").alias("max_times")
    )


STEPS = 8


def q_logistic_newton(spark, sf):
    """H5 kernel: a fixed number of Newton steps of intercept + one feature for every outer fold."""
    f = base(spark, sf)
    outer = F.broadcast(spark.range(K).select(F.col("id").cast("int").alias("outer")))
    rows = f.base.crossJoin(outer).where("fold <> outer").withColumn("x", F.col("qty") / 50)
    return rounded(linear.fit_logistic(rows, ["outer"], ["x"], "y", max_iter=STEPS - 1, tol=0.0).select("outer", "b0", "b1"))


def q_tree_leaf_table(spark, sf):
    leaves, info = zoo.tree_leaf_table(model_folds(spark, sf), FEATS)
    return leaves.withColumn("root_attr", F.lit(info["root_attr"])).withColumn("depth", F.lit(info["depth"]))


def q_tree_rules(spark, sf):
    """The shallow tree's rules and importances as rows."""
    _, info = zoo.tree_leaf_table(model_folds(spark, sf), FEATS)
    lines = [(i, "rule", x.strip(), None) for i, x in enumerate(info["rules"].splitlines()[1:])]
    lines += [(i, "importance", a, round(v, 9)) for i, (a, v) in enumerate(info["importances"].items())]
    return spark.createDataFrame(lines, "place int, kind string, entry string, value double")


def q_cost_variants(spark, sf):
    """Four variants; each outer fold's threshold comes from inner out-of-fold scores of its
    TRAINING part and is applied to its test rows. H15: the balanced variant is the counter-example."""
    inner, test = zoo.cost_variant_scores(base(spark, sf))
    test = test.withColumnRenamed("fold", "outer")
    out = decision.cost_variant_summary(inner.withColumnRenamed("fold", "outer"), test, ["model"])
    quality = test.groupBy("model").agg(F.avg((F.col("score") - F.col("y")) ** 2).alias("brier"), F.bool_and("converged").alias("converged"))
    ap = metrics.average_precision(test, ["model"])
    return rounded(out.join(quality, "model").join(ap, "model").withColumn("counter_example", F.col("model") == "logistic_balanced"))


def q_model_comparison(spark, sf):
    """I13-I15 and I10 on the zoo itself: every model's fold metrics, summary, pooled confusion and whether it beats both dummies."""
    f = base(spark, sf)
    parts = [zoo.dummy_cv(f.base, K, s) for s in ("most_frequent", "stratified")]
    parts += [forest.tree_cv(f, m) for m in ("tree_default", "tree_shallow_balanced", "rf_balanced", "gradient_boosting")]
    parts += [zoo.logistic_cv(f, balanced=b) for b in (True, False)]
    cols = ["model", "rep", "fold", "row_id", "y", "score", "pred"]
    scored = parts[0].select(cols)
    for p in parts[1:]:
        scored = scored.unionByName(p.select(cols))
    return comparison(keep(scored))


def comparison(scored):
    """Models in report order (dummies first) with summary, pooled confusion and dummy flags."""
    fm = keep(metrics.fold_metrics(scored, GROUP))
    pooled = scored.groupBy("model").agg(*[F.count_if((F.col("y") == y) & (F.col("pred") == p)).alias(n) for n, y, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))])
    wide = fm.groupBy("model").agg(F.avg("average_precision").alias("ap_mean"), F.stddev_samp("average_precision").alias("ap_sd"), F.avg("roc_auc").alias("auc_mean"), F.avg("brier_score_loss").alias("brier_mean"), F.count("*").alias("n_folds"))
    floor = wide.where(F.col("model").startswith("dummy_")).agg(F.max("ap_mean").alias("dummy_ap"))
    order = F.array_position(F.array(*[F.lit(m) for m in zoo.MODEL_NAMES]), F.col("model"))
    top = wide.where(~F.col("model").startswith("dummy_")).agg(F.max("ap_mean").alias("top_ap"))
    out = wide.join(pooled, "model").crossJoin(F.broadcast(floor)).crossJoin(F.broadcast(top))
    out = out.withColumn("place", order.cast("int")).withColumn("beats_dummies", F.when(F.col("model").startswith("dummy_"), F.lit(False)).otherwise(F.col("ap_mean") > F.col("dummy_ap")))
    return rounded(out.withColumn("best", F.col("ap_mean") == F.col("top_ap")).drop("dummy_ap", "top_ap"))


QUERIES = {
    "zoo_logistic_plain": q_zoo_logistic_plain,
    "zoo_logistic_balanced": q_zoo_logistic_balanced,
    "zoo_tree_default": q_zoo_tree_default,
    "zoo_tree_shallow": q_zoo_tree_shallow,
    "zoo_rf": q_zoo_rf,
    "zoo_gbt": q_zoo_gbt,
    "grid_search_c": q_grid_search_c,
    "nested_cv": q_nested_cv,
    "calibrate_platt": q_calibrate_platt,
    "calibrate_isotonic": q_calibrate_isotonic,
    "tree_rules": q_tree_rules,
    "model_comparison": q_model_comparison,
    "oof_predictions": q_oof_predictions,
    "logistic_newton": q_logistic_newton,
    "tree_leaf_table": q_tree_leaf_table,
    "cost_variants": q_cost_variants,
}


def _newton_sql() -> str:
    """The same steps as chained CTEs: each solves its 2x2 system in closed form."""
    steps = ["t AS MATERIALIZED (SELECT outer_f, y, qty / 50 AS x FROM ex WHERE role = 'train')", "n0 AS (SELECT DISTINCT outer_f, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 FROM t)"]
    for k in range(STEPS):
        steps.append(f"""s{k} AS MATERIALIZED (SELECT outer_f, b0, b1, sum(p - y) AS g0, sum((p - y) * x) + b1 AS g1,
            sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) + 1 AS h11
            FROM (SELECT t.*, b0, b1, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM t JOIN n{k} USING (outer_f)) GROUP BY outer_f, b0, b1)""")
        steps.append(f"""n{k + 1} AS (SELECT outer_f, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS b0,
            b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b1 FROM s{k})""")
    return with_(OBS_CTE, TAGGED, VALID, FOLDS, EXP, *steps) + f"SELECT outer_f AS outer, round(b0, 6) AS b0, round(b1, 6) AS b1 FROM n{STEPS}"


ORACLE = {
    "logistic_newton": _newton_sql(),
    "oof_predictions": FE + """SELECT 'logistic_balanced' AS model, count(*) AS rows_scored, min(times) AS min_times, max(times) AS max_times
        FROM (SELECT row_id, count(*) AS times FROM ex WHERE role = 'test' GROUP BY row_id)""",
}
