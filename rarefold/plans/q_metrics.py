"""Registered queries, sections H1/H2 (dummies), I (metrics), J3/J4 and K (decisions).

The metric layer runs on a scored table built from FIXED scoring expressions
(plus the two dummy models fitted per fold), so it is checked independently of
any training.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rarefold.functions.cache import keep
from rarefold.functions.columns import md5_uniform
from rarefold.operators import decision, metrics
from rarefold.plans.common import rounded, valid
from rarefold.plans.oracle_base import OBS, TAGGED, VALID, with_
from rarefold.plans.q_resample import FOLDS, K
from rarefold.operators import resample
from rarefold.spec import COSTS

MODEL_ORDER = {"dummy_majority": 0, "dummy_stratified": 1, "fixed_disc": 2, "fixed_logit": 3}
T_STAR = COSTS.theoretical_threshold()


def base_folds(spark, sf):
    v = valid(spark, sf).select("row_id", "failure", "line", "qty", "disc")  # what the kernel stores
    f = resample.stratified_folds(v, "failure", k=K, seed=42)
    y = (F.col("failure") == "yes").cast("int")
    f = keep(f.select(
        "row_id", "rep", "fold", "line", y.alias("y"),
        F.round(1 / (1 + F.exp(-(F.lit(-5.5) + 0.08 * F.col("qty") + 25 * F.col("disc")))), 4).alias("s_logit"),
        F.round(1 / (1 + F.exp(-(F.lit(-4.5) + 20 * F.col("disc")))), 4).alias("s_disc"),
    ))
    per = f.groupBy("rep", "fold").agg(F.count(F.lit(1)).alias("n_f"), F.sum("y").alias("p_f"))
    tot = per.groupBy("rep").agg(F.sum("n_f").alias("n_all"), F.sum("p_f").alias("p_all"))
    prev = per.join(tot, "rep").select("rep", "fold", ((F.col("p_all") - F.col("p_f")) / (F.col("n_all") - F.col("n_f"))).alias("train_prev"))
    return f.join(F.broadcast(prev), ["rep", "fold"])


def scored_models(spark, sf, models=None):
    """(model, rep, fold, row_id, line, y, score, pred) for the four fixed models (or the named ones), out of fold.

    One pass over the stored folded rows: the models are an array of each row, not branches of a union, and are made in flight."""
    maj = (F.col("train_prev") > 0.5).cast("int")
    u = md5_uniform(F.lit("42"), F.lit("strat"), F.col("rep").cast("string"), F.col("fold").cast("string"), F.col("row_id"))
    strat = (u < F.col("train_prev")).cast("int")
    made = {
        "fixed_logit": (F.col("s_logit"), (F.col("s_logit") > 0.5).cast("int")),
        "fixed_disc": (F.col("s_disc"), (F.col("s_disc") > 0.5).cast("int")),
        "dummy_majority": (maj.cast("double"), maj),
        "dummy_stratified": (strat.cast("double"), strat),
    }
    each = [F.struct(F.lit(m).alias("model"), made[m][0].alias("score"), made[m][1].alias("pred")) for m in models or made]
    out = base_folds(spark, sf).select("rep", "fold", "row_id", "line", "y", F.explode(F.array(*each)).alias("m"))
    return out.select("m.model", "rep", "fold", "row_id", "line", "y", "m.score", "m.pred")


def _fm(spark, sf):
    return keep(metrics.fold_metrics(scored_models(spark, sf), ["model", "rep", "fold"]))


def _summary(spark, sf):
    fm = _fm(spark, sf)
    return metrics.model_summary(metrics.metrics_long(fm, ["model", "rep", "fold"]), MODEL_ORDER)


def q_dummy_majority(spark, sf):
    s = scored_models(spark, sf, ("dummy_majority",))
    return rounded(metrics.fold_metrics(s, ["model", "rep", "fold"]))


def q_dummy_stratified(spark, sf):
    s = scored_models(spark, sf, ("dummy_stratified",))
    return rounded(metrics.fold_metrics(s, ["model", "rep", "fold"]))


def q_confusion_matrix(spark, sf):
    return rounded(metrics.confusion(scored_models(spark, sf), ["model"]))


def q_threshold_metrics(spark, sf):
    return rounded(metrics.threshold_metrics(scored_models(spark, sf), ["model"]))


def q_brier(spark, sf):
    return rounded(metrics.brier(scored_models(spark, sf), ["model"]))


def q_roc_auc(spark, sf):
    return rounded(metrics.roc_auc(scored_models(spark, sf), ["model"]))


def q_average_precision(spark, sf):
    return rounded(metrics.average_precision(scored_models(spark, sf), ["model"]))


def q_pr_curve(spark, sf):
    c = metrics.curves(scored_models(spark, sf, ("fixed_logit", "fixed_disc")), ["model"])
    return rounded(c.select("model", "threshold", "precision", "recall", "chance"))


def q_roc_curve(spark, sf):
    c = metrics.curves(scored_models(spark, sf, ("fixed_logit", "fixed_disc")), ["model"])
    return rounded(c.select("model", "threshold", "fpr", "tpr"))


def q_fold_metrics(spark, sf):
    return rounded(_fm(spark, sf))


def q_oof_confusion(spark, sf):
    return rounded(metrics.oof_confusion(scored_models(spark, sf), ["model"]))


def q_wilson_ci(spark, sf):
    c = metrics.confusion(scored_models(spark, sf), ["model", "fold"])
    c = c.select("model", "fold", "tp", (F.col("tp") + F.col("fn")).alias("n_pos"))
    return rounded(metrics.wilson_ci(c, "tp", "n_pos"))


def q_bootstrap_ci(spark, sf):
    fm = _fm(spark, sf)
    long = metrics.metrics_long(fm, ["model", "rep", "fold"])
    return rounded(metrics.bootstrap_ci(long, ["model", "metric"], ["rep", "fold"]))


def q_model_summary(spark, sf):
    return rounded(_summary(spark, sf))


def q_best_model(spark, sf):
    return rounded(metrics.best_model(_summary(spark, sf)))


def q_beats_dummy(spark, sf):
    return rounded(metrics.beats_dummy(_summary(spark, sf)))


def q_reliability_curve(spark, sf):
    return rounded(decision.reliability_curve(scored_models(spark, sf), ["model"]))


def q_brier_decomposition(spark, sf):
    return rounded(decision.brier_decomposition(scored_models(spark, sf), ["model"]))


def q_realized_cost(spark, sf):
    return rounded(decision.realized_cost(scored_models(spark, sf), ["model"]))


def q_expected_cost(spark, sf):
    return rounded(decision.expected_cost(scored_models(spark, sf), ["model"], T_STAR))


def q_cost_curve(spark, sf):
    s = scored_models(spark, sf, ("fixed_logit",))
    return rounded(decision.cost_curve(s, ["model"]))


def q_optimal_threshold(spark, sf):
    return rounded(decision.optimal_threshold(scored_models(spark, sf), ["model"]))


def q_theoretical_threshold(spark, sf):
    s = scored_models(spark, sf, ("fixed_logit",))
    ct = spark.createDataFrame(
        [(line, COSTS.tn, COSTS.fp, 20_000_000.0 if line == 7 else COSTS.fn, COSTS.tp) for line in range(1, 8)],
        "line int, c_tn double, c_fp double, c_fn double, c_tp double",
    )
    return rounded(decision.theoretical_threshold(s, "line", ct))


def q_cost_scenarios(spark, sf):
    s = scored_models(spark, sf, ("fixed_logit",))
    sc = spark.createDataFrame(
        [(f"fn_{int(c / 1e6)}M", COSTS.tn, COSTS.fp, c, COSTS.tp) for c in (2e6, 5e6, 10e6, 20e6, 50e6)],
        "scenario string, c_tn double, c_fp double, c_fn double, c_tp double",
    )
    return rounded(decision.cost_scenarios(s, sc))


def q_cost_at_threshold(spark, sf):
    s = scored_models(spark, sf, ("fixed_logit",))
    return rounded(decision.cost_at_threshold(decision.cost_curve(s, ["model"]), ["model"], T_STAR))


def q_cost_variant_summary(spark, sf):
    s = scored_models(spark, sf, ("fixed_logit", "fixed_disc"))
    ex = resample.fold_expansion(s, K)
    train = ex.filter(F.col("role") == "train")
    test = ex.filter(F.col("role") == "test")
    return rounded(decision.cost_variant_summary(train, test, ["model"]))


QUERIES = {
    "dummy_majority": q_dummy_majority,
    "dummy_stratified": q_dummy_stratified,
    "confusion_matrix": q_confusion_matrix,
    "threshold_metrics": q_threshold_metrics,
    "brier": q_brier,
    "roc_auc": q_roc_auc,
    "average_precision": q_average_precision,
    "pr_curve": q_pr_curve,
    "roc_curve": q_roc_curve,
    "fold_metrics": q_fold_metrics,
    "oof_confusion": q_oof_confusion,
    "wilson_ci": q_wilson_ci,
    "bootstrap_ci": q_bootstrap_ci,
    "model_summary": q_model_summary,
    "best_model": q_best_model,
    "beats_dummy": q_beats_dummy,
    "reliability_curve": q_reliability_curve,
    "brier_decomposition": q_brier_decomposition,
    "realized_cost": q_realized_cost,
    "expected_cost": q_expected_cost,
    "cost_curve": q_cost_curve,
    "optimal_threshold": q_optimal_threshold,
    "theoretical_threshold": q_theoretical_threshold,
    "cost_scenarios": q_cost_scenarios,
    "cost_at_threshold": q_cost_at_threshold,
    "cost_variant_summary": q_cost_variant_summary,
}

# ---------------------------------------------------------------- oracle SQL

D = "CAST('{}' AS DOUBLE)".format
SM = """fb AS (
  SELECT f.row_id, f.rep, f.fold, f.line, f.y,
         round(1 / (1 + exp(-(-5.5 + 0.08 * qty + 25 * disc))), 4) AS s_logit,
         round(1 / (1 + exp(-(-4.5 + 20 * disc))), 4) AS s_disc,
         (t.p_all - t.p_f) / (t.n_all - t.n_f) AS train_prev
  FROM folds f JOIN (SELECT rep, fold, count(*) AS n_f, sum(y) AS p_f, sum(count(*)) OVER (PARTITION BY rep) AS n_all,
                            sum(sum(y)) OVER (PARTITION BY rep) AS p_all FROM folds GROUP BY rep, fold) t
    ON f.rep = t.rep AND f.fold = t.fold),
sm AS (
  SELECT 'fixed_logit' AS model, rep, fold, row_id, line, y, s_logit AS score, CAST(s_logit > 0.5 AS INTEGER) AS pred FROM fb
  UNION ALL SELECT 'fixed_disc', rep, fold, row_id, line, y, s_disc, CAST(s_disc > 0.5 AS INTEGER) FROM fb
  UNION ALL SELECT 'dummy_majority', rep, fold, row_id, line, y, CAST(train_prev > 0.5 AS DOUBLE), CAST(train_prev > 0.5 AS INTEGER) FROM fb
  UNION ALL SELECT 'dummy_stratified', rep, fold, row_id, line, y,
         CAST(CAST(('0x' || substr(md5(concat_ws('|', '42', 'strat', rep, fold, row_id)), 1, 13)) AS BIGINT) / 4503599627370496.0 < train_prev AS DOUBLE),
         CAST(CAST(('0x' || substr(md5(concat_ws('|', '42', 'strat', rep, fold, row_id)), 1, 13)) AS BIGINT) / 4503599627370496.0 < train_prev AS INTEGER) FROM fb)"""
SMB = with_(OBS, TAGGED, VALID, FOLDS, SM)

CONF = """SELECT model, count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp,
                 count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp"""


def _tm(src: str) -> str:
    return f"""round((tn + tp) / (tn + fp + fn + tp), 6) AS accuracy,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
       round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2
                  WHEN tp + fn > 0 THEN tp / (tp + fn) WHEN tn + fp > 0 THEN tn / (tn + fp) END, 6) AS balanced_accuracy"""


AUC_CTE = """g AS (SELECT {g}, score, sum(y) AS npos, sum(1 - y) AS nneg FROM {src} GROUP BY {g}, score),
auc_c AS (SELECT *, coalesce(sum(nneg) OVER (PARTITION BY {g} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb,
                 sum(npos) OVER (PARTITION BY {g} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tpc,
                 sum(nneg) OVER (PARTITION BY {g} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fpc FROM g),
auc AS (SELECT {g}, CASE WHEN sum(npos) > 0 AND sum(nneg) > 0 THEN sum(npos * (nb + nneg / 2.0)) / (sum(npos) * sum(nneg)) END AS roc_auc,
               CASE WHEN sum(npos) > 0 THEN sum(npos * tpc / (tpc + fpc)) / sum(npos) END AS average_precision FROM auc_c GROUP BY {g})"""

FM = """fm AS (
  SELECT a.model, a.rep, a.fold, n_test, n_pos, accuracy, precision, recall, f1, balanced_accuracy, brier_score_loss, average_precision, roc_auc FROM (
    SELECT model, rep, fold, count(*) AS n_test, CAST(sum(y) AS BIGINT) AS n_pos,
           (tn + tp) / (tn + fp + fn + tp) AS accuracy,
           CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
           CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
           CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
           CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2
                WHEN tp + fn > 0 THEN tp / (tp + fn) WHEN tn + fp > 0 THEN tn / (tn + fp) END AS balanced_accuracy,
           avg((score - y) * (score - y)) AS brier_score_loss
    FROM (SELECT *, count(*) FILTER (WHERE y = 0 AND pred = 0) OVER w AS tn, count(*) FILTER (WHERE y = 0 AND pred = 1) OVER w AS fp,
                 count(*) FILTER (WHERE y = 1 AND pred = 0) OVER w AS fn, count(*) FILTER (WHERE y = 1 AND pred = 1) OVER w AS tp
          FROM sm WINDOW w AS (PARTITION BY model, rep, fold))
    GROUP BY model, rep, fold, tn, fp, fn, tp) a
  JOIN auc b ON a.model = b.model AND a.rep = b.rep AND a.fold = b.fold)"""
FM_ROUND = """SELECT model, rep, fold, n_test, n_pos, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, round(balanced_accuracy, 6) AS balanced_accuracy, round(brier_score_loss, 6) AS brier_score_loss,
       round(average_precision, 6) AS average_precision, round(roc_auc, 6) AS roc_auc FROM fm"""
FMB = SMB + ", " + AUC_CTE.format(g="model, rep, fold", src="sm") + ",\n" + FM + "\n"
LONGM = """fl AS (
  SELECT model, rep, fold, metric, value FROM fm UNPIVOT (value FOR metric IN
    (average_precision, balanced_accuracy, roc_auc, recall, precision, f1, accuracy, brier_score_loss)))"""
BOOT = """bci AS (
  SELECT model, metric, quantile_cont(mean_b, 0.025) AS ci_low, quantile_cont(mean_b, 0.975) AS ci_high FROM (
    SELECT d.model, d.metric, d.b, avg(v.value) AS mean_b FROM (
      SELECT model, metric, b, i, CAST(floor(CAST(('0x' || substr(md5(concat_ws('|', '42', model, metric, CAST(b AS VARCHAR), CAST(i AS VARCHAR))), 1, 13)) AS BIGINT)
             / 4503599627370496.0 * m) AS INTEGER) AS idx
      FROM (SELECT model, metric, count(*) AS m FROM fl WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL) mm, range(2000) tb(b), range(m) ti(i)) d
    JOIN (SELECT model, metric, value, CAST(row_number() OVER (PARTITION BY model, metric ORDER BY rep, fold) - 1 AS INTEGER) AS idx
          FROM fl WHERE value IS NOT NULL AND NOT isnan(value)) v
      ON d.model = v.model AND d.metric = v.metric AND d.idx = v.idx
    GROUP BY d.model, d.metric, d.b) GROUP BY model, metric)"""
SUMM = """summ AS (
  SELECT s.model, s.metric, mean, ci_low, ci_high,
         CASE s.model WHEN 'dummy_majority' THEN 0 WHEN 'dummy_stratified' THEN 1 WHEN 'fixed_disc' THEN 2 WHEN 'fixed_logit' THEN 3 END AS model_order
  FROM (SELECT model, metric, avg(value) AS mean FROM fl WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL) s
  LEFT JOIN bci ON s.model = bci.model AND s.metric = bci.metric)"""
SUMB = FMB + ", " + LONGM + ",\n" + BOOT + ",\n" + SUMM + "\n"

GRIDN = 1000
BKT = f"""least(greatest(CASE WHEN (floor(score * {GRIDN}) + 1) * {D(repr(1.0 / GRIDN))} <= score THEN floor(score * {GRIDN}) + 1
                          WHEN floor(score * {GRIDN}) * {D(repr(1.0 / GRIDN))} > score THEN floor(score * {GRIDN}) - 1
                          ELSE floor(score * {GRIDN}) END, -1), {GRIDN})"""


def _curve(src: str, g: str = "model") -> str:
    return f"""hist AS (SELECT {g}, CAST({BKT} AS BIGINT) AS i, sum(y) AS npos, sum(1 - y) AS nneg FROM {src} GROUP BY ALL),
cc AS (
  SELECT t.{g}, gr.i, gr.i * {D(repr(1.0 / GRIDN))} AS threshold,
         sum(coalesce(h.npos, 0)) OVER w AS tp, sum(coalesce(h.nneg, 0)) OVER w AS fp, t.P, t.N
  FROM (SELECT {g}, sum(npos) AS P, sum(nneg) AS N FROM hist GROUP BY {g}) t
  CROSS JOIN (SELECT CAST(range AS BIGINT) AS i FROM range({GRIDN + 1})) gr
  LEFT JOIN hist h ON h.{g} = t.{g} AND h.i = gr.i
  WINDOW w AS (PARTITION BY t.{g} ORDER BY gr.i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
curve AS (SELECT {g}, i, threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(P - tp AS BIGINT) AS fn, CAST(N - fp AS BIGINT) AS tn,
                 CAST((N - fp) * 0.0 + fp * 500000.0 + (P - tp) * 10000000.0 + tp * 1500000.0 AS DOUBLE) AS cost FROM cc)"""


OPT = """opt AS (SELECT {g}, quantile_cont(threshold, 0.5) AS optimal_threshold, min(cost) AS min_cost, count(*) AS n_tied
       FROM (SELECT *, min(cost) OVER (PARTITION BY {g}) AS mc FROM {src}) WHERE cost = mc GROUP BY {g})"""

SCEN = "(VALUES " + ", ".join(f"('fn_{int(c / 1e6)}M', 0.0::DOUBLE, 500000.0::DOUBLE, {c}::DOUBLE, 1500000.0::DOUBLE)" for c in (2e6, 5e6, 10e6, 20e6, 50e6)) + ") sc(scenario, c_tn, c_fp, c_fn, c_tp)"

EDGES = [i * (1.0 / 10) for i in range(1, 10)]
RBIN = "least(greatest(" + " + ".join(f"CAST(score >= {D(repr(e))} AS INTEGER)" for e in EDGES) + ", 0), 9)"
ALL_EDGES = [0.0] + EDGES + [1.0]
RGRID = "(VALUES " + ", ".join(f"({i}, {D(repr(ALL_EDGES[i]))}, {D(repr(ALL_EDGES[i + 1]))})" for i in range(10)) + ") gr(bin, lower, upper)"
REL = f"""rel AS (
  SELECT m.model, gr.bin, lower, upper, coalesce(a.n, 0) AS n, a.mean_predicted, a.observed_freq
  FROM (SELECT DISTINCT model FROM sm) m CROSS JOIN {RGRID}
  LEFT JOIN (SELECT model, CAST({RBIN} AS INTEGER) AS bin, count(*) AS n, avg(score) AS mean_predicted, avg(y) AS observed_freq FROM sm GROUP BY ALL) a
    ON a.model = m.model AND a.bin = gr.bin)"""

ORACLE = {
    "dummy_majority": FMB + FM_ROUND + " WHERE model = 'dummy_majority'",
    "dummy_stratified": FMB + FM_ROUND + " WHERE model = 'dummy_stratified'",
    "confusion_matrix": SMB
    + f"""SELECT model, tn, fp, fn, tp, round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END, 6) AS tnr, round(CASE WHEN tn + fp > 0 THEN fp / (tn + fp) END, 6) AS fpr,
                 round(CASE WHEN fn + tp > 0 THEN fn / (fn + tp) END, 6) AS fnr, round(CASE WHEN fn + tp > 0 THEN tp / (fn + tp) END, 6) AS tpr
          FROM ({CONF} FROM sm GROUP BY model)""",
    "threshold_metrics": SMB + f"SELECT model, tn, fp, fn, tp, {_tm('')} FROM ({CONF} FROM sm GROUP BY model)",
    "brier": SMB + "SELECT model, round(avg((score - y) * (score - y)), 6) AS brier_score_loss, count(*) AS n FROM sm GROUP BY model",
    "roc_auc": SMB + ", " + AUC_CTE.format(g="model", src="sm") + " SELECT model, round(roc_auc, 6) AS roc_auc FROM auc",
    "average_precision": SMB + ", " + AUC_CTE.format(g="model", src="sm") + " SELECT model, round(average_precision, 6) AS average_precision FROM auc",
    "pr_curve": SMB
    + """, g AS (SELECT model, score, sum(y) AS npos, sum(1 - y) AS nneg FROM sm WHERE model IN ('fixed_logit', 'fixed_disc') GROUP BY ALL),
         c AS (SELECT *, sum(npos) OVER w AS tp, sum(nneg) OVER w AS fp, sum(npos) OVER (PARTITION BY model) AS P, sum(nneg) OVER (PARTITION BY model) AS N
               FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT model, round(score, 6) AS threshold, round(tp / (tp + fp), 6) AS precision, round(CASE WHEN P > 0 THEN tp / P END, 6) AS recall,
           round(P / (P + N), 6) AS chance FROM c""",
    "roc_curve": SMB
    + """, g AS (SELECT model, score, sum(y) AS npos, sum(1 - y) AS nneg FROM sm WHERE model IN ('fixed_logit', 'fixed_disc') GROUP BY ALL),
         c AS (SELECT *, sum(npos) OVER w AS tp, sum(nneg) OVER w AS fp, sum(npos) OVER (PARTITION BY model) AS P, sum(nneg) OVER (PARTITION BY model) AS N
               FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT model, round(score, 6) AS threshold, round(CASE WHEN N > 0 THEN fp / N END, 6) AS fpr, round(CASE WHEN P > 0 THEN tp / P END, 6) AS tpr FROM c""",
    "fold_metrics": FMB + FM_ROUND,
    "oof_confusion": SMB
    + """SELECT model, tn, fp, fn, tp, tn + fp AS n_neg, fn + tp AS n_pos, round(CASE WHEN fn + tp > 0 THEN tp / (fn + tp) END, 6) AS recall,
                round((tn + tp) / (tn + fp + fn + tp), 6) AS accuracy,
                round(CASE WHEN n > 0 THEN (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n) END, 6) AS ci_low,
                round(CASE WHEN n > 0 THEN (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n) END, 6) AS ci_high
         FROM (SELECT *, CAST(fn + tp AS DOUBLE) AS n, tp / (fn + tp) AS p, 1.959963984540054 AS z FROM (""" + CONF + " FROM sm GROUP BY model))",
    "wilson_ci": SMB
    + """SELECT model, fold, tp, n_pos,
                round(CASE WHEN n > 0 THEN (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n) END, 6) AS ci_low,
                round(CASE WHEN n > 0 THEN (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n) END, 6) AS ci_high
         FROM (SELECT model, fold, tp, fn + tp AS n_pos, CAST(fn + tp AS DOUBLE) AS n, tp / (fn + tp) AS p, 1.959963984540054 AS z FROM (
               SELECT model, fold, count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp FROM sm GROUP BY model, fold))""",
    "bootstrap_ci": FMB + ", " + LONGM + ",\n" + BOOT + "\nSELECT model, metric, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM bci",
    "model_summary": SUMB + "SELECT model, metric, round(mean, 6) AS mean, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, model_order FROM summ",
    "best_model": SUMB
    + "SELECT model AS best_model, round(mean, 6) AS best_ap FROM summ WHERE metric = 'average_precision' ORDER BY mean DESC, model_order LIMIT 1",
    "beats_dummy": SUMB
    + """SELECT model, round(mean, 6) AS ap, round(d, 6) AS best_dummy_ap, mean > d AS beats_dummies
         FROM summ, (SELECT max(mean) AS d FROM summ WHERE metric = 'average_precision' AND model IN ('dummy_majority', 'dummy_stratified'))
         WHERE metric = 'average_precision' AND model NOT IN ('dummy_majority', 'dummy_stratified')""",
    "reliability_curve": SMB + ", " + REL
    + " SELECT model, bin, round(lower, 6) AS lower, round(upper, 6) AS upper, n, round(mean_predicted, 6) AS mean_predicted, round(observed_freq, 6) AS observed_freq FROM rel",
    "brier_decomposition": SMB + ", " + REL
    + """, tot AS (SELECT model, count(*) AS n_total, avg(y) AS obar, avg((score - y) * (score - y)) AS brier_score FROM sm GROUP BY model)
    SELECT tot.model, round(brier_score, 6) AS brier_score, round(rl, 6) AS reliability, round(rs, 6) AS resolution, round(obar * (1 - obar), 6) AS uncertainty,
           round(rl - rs + obar * (1 - obar), 6) AS reconstruction
    FROM tot JOIN (SELECT rel.model, sum(n * (mean_predicted - observed_freq) ^ 2) / any_value(n_total) AS rl, sum(n * (observed_freq - obar) ^ 2) / any_value(n_total) AS rs
                   FROM rel JOIN tot ON rel.model = tot.model WHERE n > 0 GROUP BY rel.model) x ON tot.model = x.model""",
    "realized_cost": SMB
    + f"SELECT model, tn, fp, fn, tp, round(CAST(tn * 0.0 + fp * 500000.0 + fn * 10000000.0 + tp * 1500000.0 AS DOUBLE), 6) AS cost FROM ({CONF} FROM sm GROUP BY model)",
    "expected_cost": SMB
    + f"""SELECT model, tn, fp, fn, tp, round(CAST(tn * 0.0 + fp * 500000.0 + fn * 10000000.0 + tp * 1500000.0 AS DOUBLE), 6) AS cost, round({D(repr(T_STAR))}, 6) AS threshold
          FROM (SELECT model, count(*) FILTER (WHERE y = 0 AND NOT p) AS tn, count(*) FILTER (WHERE y = 0 AND p) AS fp,
                       count(*) FILTER (WHERE y = 1 AND NOT p) AS fn, count(*) FILTER (WHERE y = 1 AND p) AS tp
                FROM (SELECT *, score >= {D(repr(T_STAR))} AS p FROM sm) GROUP BY model)""",
    "cost_curve": SMB + ", " + _curve("(SELECT * FROM sm WHERE model = 'fixed_logit')")
    + " SELECT model, i, round(threshold, 6) AS threshold, tp, fp, fn, tn, round(cost, 6) AS cost FROM curve",
    "optimal_threshold": SMB + ", " + _curve("sm") + ", " + OPT.format(g="model", src="curve")
    + " SELECT model, round(optimal_threshold, 6) AS optimal_threshold, round(min_cost, 6) AS min_cost, n_tied FROM opt",
    "theoretical_threshold": SMB
    + """SELECT line, round(t_star, 6) AS t_star, c_tn, c_fp, c_fn, c_tp, tn, fp, fn, tp, round(tn * c_tn + fp * c_fp + fn * c_fn + tp * c_tp, 6) AS cost FROM (
           SELECT s.line, t_star, c_tn, c_fp, c_fn, c_tp,
                  count(*) FILTER (WHERE y = 0 AND score < t_star) AS tn, count(*) FILTER (WHERE y = 0 AND score >= t_star) AS fp,
                  count(*) FILTER (WHERE y = 1 AND score < t_star) AS fn, count(*) FILTER (WHERE y = 1 AND score >= t_star) AS tp
           FROM (SELECT * FROM sm WHERE model = 'fixed_logit') s JOIN (
             SELECT line, c_tn, c_fp, c_fn, c_tp, (c_fp - c_tn) / ((c_fp - c_tn) + (c_fn - c_tp)) AS t_star FROM (
               SELECT CAST(l AS INTEGER) AS line, 0.0::DOUBLE AS c_tn, 500000.0::DOUBLE AS c_fp,
                      CASE WHEN l = 7 THEN 20000000.0 ELSE 10000000.0 END::DOUBLE AS c_fn, 1500000.0::DOUBLE AS c_tp FROM range(1, 8) t(l))) ct
           ON s.line = ct.line GROUP BY ALL)""",
    "cost_scenarios": SMB + ", " + _curve("(SELECT 'all' AS g0, * FROM sm WHERE model = 'fixed_logit')", g="g0")
    + f""", sj AS (SELECT scenario, i, threshold, tp, fp, fn, tn, tn * c_tn + fp * c_fp + fn * c_fn + tp * c_tp AS cost FROM curve, {SCEN}),
    """ + OPT.format(g="scenario", src="sj")
    + """ SELECT opt.scenario, round(optimal_threshold, 6) AS optimal_threshold, round(min_cost, 6) AS min_cost, n_tied,
                 round(a.cost, 6) AS cost_at_05, a.tp AS tp_05, a.fp AS fp_05, a.fn AS fn_05, a.tn AS tn_05,
                 round(a.cost - min_cost, 6) AS saving, round(CASE WHEN a.cost <> 0 THEN 100.0 * (a.cost - min_cost) / a.cost END, 6) AS saving_pct
          FROM opt JOIN (SELECT * FROM sj WHERE i = 500) a ON opt.scenario = a.scenario""",
    "cost_at_threshold": SMB + ", " + _curve("(SELECT * FROM sm WHERE model = 'fixed_logit')")
    + f""" SELECT model, round({D(repr(T_STAR))}, 6) AS t,
                 round(CASE WHEN t_next IS NULL THEN cost ELSE cost + ({D(repr(T_STAR))} - threshold) / (t_next - threshold) * (c_next - cost) END, 6) AS cost_at_t
          FROM (SELECT *, lead(threshold) OVER (PARTITION BY model ORDER BY i) AS t_next, lead(cost) OVER (PARTITION BY model ORDER BY i) AS c_next FROM curve)
          WHERE threshold <= {D(repr(T_STAR))} AND (t_next > {D(repr(T_STAR))} OR t_next IS NULL)""",
    "cost_variant_summary": SMB
    + """, ex AS (SELECT s.*, CAST(o.outer_ AS INTEGER) AS outer_f, CASE WHEN fold = o.outer_ THEN 'test' ELSE 'train' END AS role
                FROM (SELECT * FROM sm WHERE model IN ('fixed_logit', 'fixed_disc')) s, range(5) o(outer_)), """
    + _curve("(SELECT model || '#' || outer_f AS mo, * FROM ex WHERE role = 'train')", g="mo")
    + ", " + OPT.format(g="mo", src="curve")
    + """, tf AS (SELECT split_part(mo, '#', 1) AS model, CAST(split_part(mo, '#', 2) AS INTEGER) AS outer_f, optimal_threshold AS t_fold FROM opt),
       te AS (SELECT e.*, t_fold, CAST(score >= t_fold AS INTEGER) AS pt, CAST(score >= 0.5 AS INTEGER) AS p5
              FROM ex e JOIN tf ON e.model = tf.model AND e.outer_f = tf.outer_f WHERE role = 'test'),
       agg AS (SELECT model, count(*) FILTER (WHERE y = 0 AND pt = 0) AS tn, count(*) FILTER (WHERE y = 0 AND pt = 1) AS fp,
                      count(*) FILTER (WHERE y = 1 AND pt = 0) AS fn, count(*) FILTER (WHERE y = 1 AND pt = 1) AS tp,
                      count(*) FILTER (WHERE y = 0 AND p5 = 1) * 500000.0 + count(*) FILTER (WHERE y = 1 AND p5 = 0) * 10000000.0
                        + count(*) FILTER (WHERE y = 1 AND p5 = 1) * 1500000.0 AS c05 FROM te GROUP BY model),
       agg2 AS (SELECT model, tn, fp, fn, tp, CAST(c05 AS DOUBLE) AS c05, CAST(fp * 500000.0 + fn * 10000000.0 + tp * 1500000.0 AS DOUBLE) AS ct FROM agg)
    SELECT agg2.model, round(med, 6) AS empirical_threshold, tn, fp, fn, tp, round(c05, 6) AS cost_at_05,
           round(ct, 6) AS cost_at_threshold, round(c05 - ct, 6) AS saving,
           round(CASE WHEN c05 <> 0 THEN 100.0 * (c05 - ct) / c05 END, 6) AS saving_pct
    FROM agg2 JOIN (SELECT model, quantile_cont(t_fold, 0.5) AS med FROM tf GROUP BY model) m ON agg2.model = m.model""",
}
