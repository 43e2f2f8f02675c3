"""Registered queries, sections L (explain), M (limits), N (comparison)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rarefold.operators import compare, explain, forest, limits, profile
from rarefold.plans.common import rounded, valid
from rarefold.plans.oracle_base import OBS, TAGGED, VALID, with_
from rarefold.plans.q_metrics import GRIDN, OPT, _curve
from rarefold.plans.q_models import K, model_folds
from rarefold.sources import bindings
from rarefold.spec import OBS as SPEC

FEATS = list(SPEC.features)
# Coefficients of the fixed linear model used to check the SHAP layer.
INTERCEPT = -3.5
BETA = {"qty": 1.0, "price": 0.0, "disc": 0.8, "tax": 0.1, "line": -0.1}


def _yv(spark, sf):
    return valid(spark, sf).withColumn("y", (F.col("failure") == "yes").cast("int")).select("row_id", "y", "line", *[c for c in FEATS if c != "line"])


def _shap(spark, sf):
    v = valid(spark, sf).withColumn("y", (F.col("failure") == "yes").cast("int")).select("row_id", "y", *FEATS)
    z = explain.standardize_full(v, FEATS)
    return explain.linear_shap(z, BETA, INTERCEPT, FEATS)


def q_linear_shap(spark, sf):
    return rounded(_shap(spark, sf))


def q_shap_importance(spark, sf):
    return rounded(explain.shap_importance(_shap(spark, sf), FEATS))


def q_shap_top3(spark, sf):
    return rounded(explain.shap_top3(_shap(spark, sf), FEATS))


def q_shap_cases(spark, sf):
    return rounded(explain.shap_cases(_shap(spark, sf), FEATS))


def q_importance_compare(spark, sf):
    imp = explain.shap_importance(_shap(spark, sf), FEATS)
    auc = profile.univariate_auc(valid(spark, sf), SPEC, with_p=False)
    return rounded(explain.importance_compare(imp, auc))


def _labelled(spark, sf):
    return valid(spark, sf).withColumn("y", (F.col("failure") == "yes").cast("int")).select("row_id", "y", *FEATS)


def q_fitted_model(spark, sf):
    """The stored coefficients that the explanations of the fitted model read."""
    return rounded(explain.fit_linear(_labelled(spark, sf), FEATS))


def q_fitted_shap_importance(spark, sf):
    rows = _labelled(spark, sf)
    return rounded(explain.shap_importance(explain.fitted_shap(rows, explain.fit_linear(rows, FEATS)), FEATS))


def q_fitted_shap_top3(spark, sf):
    rows = _labelled(spark, sf)
    return rounded(explain.shap_top3(explain.fitted_shap(rows, explain.fit_linear(rows, FEATS)), FEATS))


REPLICATES = forest.Forest(trees=300, tried=len(FEATS), min_leaf=5, depth=3)


def _replicates(spark, sf):
    return forest.replicate_trees(_labelled(spark, sf), FEATS, REPLICATES)


def q_tree_depth(spark, sf):
    """Mean effective depth of the 300 replicate trees, and how many reach each depth."""
    t = _replicates(spark, sf)
    mean = t.agg(F.avg("depth").alias("mean_depth"), F.count("*").alias("trees"))
    return rounded(t.groupBy("depth").agg(F.count("*").alias("n_trees")).crossJoin(F.broadcast(mean)))


def q_importance_three_rankings(spark, sf):
    """SHAP of the fitted model, univariate AUC and root share of the replicate trees side by side."""
    rows = _labelled(spark, sf)
    imp = explain.shap_importance(explain.fitted_shap(rows, explain.fit_linear(rows, FEATS)), FEATS)
    auc = profile.univariate_auc(valid(spark, sf), SPEC, with_p=False)
    counts = _replicates(spark, sf).groupBy(F.col("root_attr").alias("attr")).agg(F.count("*").alias("n_root"))
    every = spark.createDataFrame([(a,) for a in FEATS], "attr string")
    root = every.join(F.broadcast(counts), "attr", "left").select("attr", (100.0 * F.coalesce("n_root", F.lit(0)) / REPLICATES.trees).alias("pct_root"))
    return rounded(explain.importance_compare(imp, auc, root))


def q_root_stability(spark, sf):
    f = valid(spark, sf).withColumn("y", (F.col("failure") == "yes").cast("int")).select("row_id", "y", *FEATS)
    return rounded(explain.root_stability(f, FEATS, "y", n_boot=300))


def _seg(spark, sf):
    return limits.segment_prevalence(_yv(spark, sf), "line")


def q_required_positives(spark, sf):
    r = limits.required_positives(_seg(spark, sf), limits.scenarios(spark))
    return rounded(r.select("line", "target_recall", "margin", "positives_needed"))


def q_required_observations(spark, sf):
    r = limits.required_positives(_seg(spark, sf), limits.scenarios(spark))
    return rounded(r.select("line", "margin", "n", "n_pos", "prevalence", "positives_needed", "observations_needed"))


def q_target_recall_ci(spark, sf):
    return rounded(limits.target_recall_ci(_seg(spark, sf)))


def q_learning_curve(spark, sf):
    return rounded(limits.learning_curve(model_folds(spark, sf), FEATS, K))


def q_learning_curve_norm(spark, sf):
    f = model_folds(spark, sf)
    n = f.count()
    return rounded(limits.learning_curve_norm(limits.learning_curve(f, FEATS, K), n))


def _two_datasets(spark, sf):
    half = (F.ascii(F.substring(F.md5("row_id"), 1, 1)) % 2).alias("half")
    li = bindings.scored(valid(spark, sf)).select(F.lit("lineitem").alias("dataset"), half, "y", "score")
    ev = bindings.event_observations(spark, sf).select(
        F.lit("events").alias("dataset"),
        half,
        (F.col("failure") == "yes").cast("int").alias("y"),
        F.round(1 / (1 + F.exp(-(F.lit(-1.5) + 0.01 * F.col("value")))), 4).alias("score"),
    )
    return li.unionByName(ev)


def q_dataset_comparison(spark, sf):
    return rounded(compare.dataset_comparison(_two_datasets(spark, sf)))


def q_report_completeness(spark, sf):
    from rarefold.operators import contract
    from rarefold.sources import io

    o = bindings.observations(spark, sf)
    val = io.to_report_rows(contract.contract_summary(contract.tag(o, SPEC)), "lineitem", "validation", None,
                            ["n_read", "n_valid", "n_quarantined"])
    eda = io.to_report_rows(profile.class_balance(valid(spark, sf), "failure", "yes"), "lineitem", "eda", None,
                            ["n", "n_positive", "prevalence", "majority_accuracy"])
    ev = io.to_report_rows(profile.class_balance(bindings.event_observations(spark, sf), "failure", "yes"), "events", "eda", None,
                           ["n", "n_positive", "prevalence", "majority_accuracy"])
    mart = val.unionByName(eda).unionByName(ev)
    expected = spark.createDataFrame([(d, s) for d in ("lineitem", "events") for s in ("validation", "eda")], "dataset string, section string")
    return compare.report_completeness(expected, mart)


QUERIES = {
    "report_completeness": q_report_completeness,
    "linear_shap": q_linear_shap,
    "shap_importance": q_shap_importance,
    "shap_top3": q_shap_top3,
    "shap_cases": q_shap_cases,
    "importance_compare": q_importance_compare,
    "fitted_model": q_fitted_model,
    "fitted_shap_importance": q_fitted_shap_importance,
    "fitted_shap_top3": q_fitted_shap_top3,
    "importance_three_rankings": q_importance_three_rankings,
    "tree_depth": q_tree_depth,
    "root_stability": q_root_stability,
    "required_positives": q_required_positives,
    "required_observations": q_required_observations,
    "target_recall_ci": q_target_recall_ci,
    "learning_curve": q_learning_curve,
    "learning_curve_norm": q_learning_curve_norm,
    "dataset_comparison": q_dataset_comparison,
}

# ---------------------------------------------------------------- oracle SQL

_LONGV = " UNION ALL ".join(f"SELECT '{f}' AS attr, CAST({f} AS DOUBLE) AS v FROM valid" for f in FEATS)
STATS = f"""st AS (
  SELECT m.attr, median, avg(coalesce(l.v, median)) AS mean,
         CASE WHEN stddev_pop(coalesce(l.v, median)) = 0 THEN 1.0 ELSE stddev_pop(coalesce(l.v, median)) END AS sd
  FROM ({_LONGV}) l JOIN (SELECT attr, quantile_cont(v, 0.5) AS median FROM ({_LONGV}) GROUP BY attr) m ON l.attr = m.attr
  GROUP BY m.attr, median)"""
_Z = ", ".join(
    f"(coalesce(CAST({f} AS DOUBLE), (SELECT median FROM st WHERE attr = '{f}')) - (SELECT mean FROM st WHERE attr = '{f}')) / (SELECT sd FROM st WHERE attr = '{f}') AS {f}"
    for f in FEATS
)
ZT = f"zt AS (SELECT row_id, CASE WHEN failure = 'yes' THEN 1 ELSE 0 END AS y, {_Z} FROM valid)"
_PHI = ", ".join(f"{BETA[f]!r} * ({f} - (SELECT avg({f}) FROM zt)) AS phi_{f}" for f in FEATS)
_BASE = f"{INTERCEPT!r} + " + " + ".join(f"{BETA[f]!r} * (SELECT avg({f}) FROM zt)" for f in FEATS)
SH = f"sh AS (SELECT row_id, y, {_PHI}, {_BASE} AS base_value FROM zt)"
SHL = "shl AS (" + " UNION ALL ".join(f"SELECT row_id, y, '{f}' AS attr, {i} AS ord, phi_{f} AS phi FROM sh" for i, f in enumerate(FEATS)) + ")"
SHB = with_(OBS, TAGGED, VALID, STATS, ZT, SH, SHL)
_MARGIN = " + ".join(f"phi_{f}" for f in FEATS)
TOP3 = "SELECT row_id, attr, round(phi, 6) AS phi, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(phi) DESC, ord) AS rank FROM shl WHERE y = 1 {extra}) WHERE rank <= 3"
SEG = "seg AS (SELECT line, count(*) AS n, CAST(sum(CASE WHEN failure = 'yes' THEN 1 ELSE 0 END) AS BIGINT) AS n_pos FROM valid GROUP BY line)"
SCN = "(VALUES (0.8::DOUBLE, 0.1::DOUBLE), (0.8::DOUBLE, 0.05::DOUBLE)) sc(target_recall, margin)"
RP = f"rp AS (SELECT line, n, n_pos, n_pos / n AS prevalence, target_recall, margin, CAST(ceil(1.959963984540054 * 1.959963984540054 * target_recall * (1 - target_recall) / (margin * margin)) AS BIGINT) AS positives_needed FROM seg, {SCN})"
_HALF = "ascii(substr(md5(row_id), 1, 1)) % 2 AS half"
EV = """ev AS (SELECT CAST(event_id AS VARCHAR) AS row_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y, round(1 / (1 + exp(-(-1.5 + 0.01 * value))), 4) AS score FROM events)"""
SC2 = f"sc2 AS (SELECT 'lineitem' AS dataset, {_HALF}, CASE WHEN failure = 'yes' THEN 1 ELSE 0 END AS y, round(1 / (1 + exp(-(-5.5 + 0.08 * qty + 25 * disc))), 4) AS score FROM valid UNION ALL SELECT 'events', {_HALF}, y, score FROM ev), trn AS (SELECT dataset || (1 - half) AS dh, y, score FROM sc2)"

ORACLE = {
    "report_completeness": """SELECT e.dataset, e.section, CAST(coalesce(m.n_rows, 0) AS BIGINT) AS n_rows, m.n_rows IS NOT NULL AS present
    FROM (VALUES ('lineitem', 'validation'), ('lineitem', 'eda'), ('events', 'validation'), ('events', 'eda')) e(dataset, section)
    LEFT JOIN (SELECT 'lineitem' AS dataset, 'validation' AS section, 3 AS n_rows FROM (SELECT count(*) FROM lineitem)
               UNION ALL SELECT 'lineitem', 'eda', 4 FROM (SELECT count(*) FROM lineitem)
               UNION ALL SELECT 'events', 'eda', 4 FROM (SELECT count(*) FROM events)) m
      ON e.dataset = m.dataset AND e.section = m.section""",
    "linear_shap": SHB + f"SELECT row_id, y, {', '.join(f'round(phi_{f}, 6) + 0.0 AS phi_{f}' for f in FEATS)}, round(base_value, 6) AS base_value, round(base_value + {_MARGIN}, 6) AS margin FROM sh",
    "shap_importance": SHB + "SELECT attr, round(m, 6) AS mean_abs_shap, CAST(row_number() OVER (ORDER BY m DESC, attr) AS INTEGER) AS rank FROM (SELECT attr, avg(abs(phi)) AS m FROM shl GROUP BY attr)",
    "shap_top3": SHB + TOP3.format(extra=""),
    "shap_cases": SHB + TOP3.format(extra="AND row_id IN (SELECT row_id FROM sh WHERE y = 1 ORDER BY row_id LIMIT 20)"),
    "required_positives": with_(OBS, TAGGED, VALID, SEG, RP) + "SELECT line, target_recall, margin, positives_needed FROM rp",
    "required_observations": with_(OBS, TAGGED, VALID, SEG, RP)
    + "SELECT line, margin, n, n_pos, round(prevalence, 6) AS prevalence, positives_needed, CAST(CASE WHEN prevalence > 0 THEN round_even(positives_needed / prevalence, 0) END AS BIGINT) AS observations_needed FROM rp",
    "target_recall_ci": with_(OBS, TAGGED, VALID, SEG)
    + """SELECT line, n, n_pos, round(n_pos / n, 6) AS prevalence, CAST(k AS BIGINT) AS hits,
                 round(CASE WHEN nn > 0 THEN (p + z * z / (2 * nn)) / (1 + z * z / nn) - z * sqrt(p * (1 - p) / nn + z * z / (4 * nn * nn)) / (1 + z * z / nn) END, 6) AS ci_low,
                 round(CASE WHEN nn > 0 THEN (p + z * z / (2 * nn)) / (1 + z * z / nn) + z * sqrt(p * (1 - p) / nn + z * z / (4 * nn * nn)) / (1 + z * z / nn) END, 6) AS ci_high
          FROM (SELECT *, round_even(0.8 * n_pos, 0) AS k, CAST(n_pos AS DOUBLE) AS nn, round_even(0.8 * n_pos, 0) / n_pos AS p, 1.959963984540054 AS z FROM seg)""",
    "dataset_comparison": with_(OBS, TAGGED, VALID, EV, SC2) + ", " + _curve("trn", g="dh") + ", " + OPT.format(g="dh", src="curve")
    + f""", ag AS (
      SELECT s.dataset, (SELECT avg(optimal_threshold) FROM opt WHERE dh IN (s.dataset || 0, s.dataset || 1)) AS threshold, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos,
             count(*) FILTER (WHERE y = 1 AND score >= optimal_threshold) AS tp, count(*) FILTER (WHERE y = 0 AND score >= optimal_threshold) AS fp,
             count(*) FILTER (WHERE y = 1 AND score >= 0.5) AS tp_05, count(*) FILTER (WHERE y = 0 AND score >= 0.5) AS fp_05
      FROM sc2 s JOIN opt o ON s.dataset || s.half = o.dh GROUP BY s.dataset),
    cc2 AS (SELECT *, CAST(fp * 500000.0 + (n_pos - tp) * 10000000.0 + tp * 1500000.0 AS DOUBLE) AS ct,
                      CAST(fp_05 * 500000.0 + (n_pos - tp_05) * 10000000.0 + tp_05 * 1500000.0 AS DOUBLE) AS c5,
                      CAST(n_pos AS DOUBLE) AS nn, tp / n_pos AS p, 1.959963984540054 AS z FROM ag)
    SELECT dataset, n, n_pos, round(n_pos / n, 6) AS prevalence, round(greatest(n_pos / n, 1 - n_pos / n), 6) AS majority_accuracy,
           round(threshold, 6) AS threshold, tp, round(tp / n_pos, 6) AS recall,
           round((p + z * z / (2 * nn)) / (1 + z * z / nn) - z * sqrt(p * (1 - p) / nn + z * z / (4 * nn * nn)) / (1 + z * z / nn), 6) AS ci_low,
           round((p + z * z / (2 * nn)) / (1 + z * z / nn) + z * sqrt(p * (1 - p) / nn + z * z / (4 * nn * nn)) / (1 + z * z / nn), 6) AS ci_high,
           round(c5, 6) AS cost_at_05, round(ct, 6) AS cost_at_threshold, round(CASE WHEN c5 <> 0 THEN 100.0 * (c5 - ct) / c5 END, 6) AS saving_pct
    FROM cc2""",
}
