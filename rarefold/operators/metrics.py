"""I: evaluation metrics as grouped aggregations over a scored table.

A scored table carries ``group`` columns (model, rep, fold, ...), ``y`` (0/1),
``score`` (P(positive)) and ``pred`` (0/1).  Every metric is one grouped pass;
rank metrics (ROC-AUC, step AP, curves) pre-aggregate to distinct
(group, score) and use the two-level prefix kernel, never a per-group sort of
raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarefold.functions.columns import Z_975, md5_uniform, safe_div, wilson, zero_div
from rarefold.functions.ranks import value_prefix
from rarefold.operators.profile import rank_sums

# Metric names and their report order.
METRIC_NAMES = (
    "average_precision", "balanced_accuracy", "roc_auc", "recall",
    "precision", "f1", "accuracy", "brier_score_loss",
)


def confusion(scored: DataFrame, group: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """Tn fp fn tp per group plus row-normalised rates (0 denominators -> null)."""
    c = scored.groupBy(*group).agg(
        F.count_if((F.col(y) == 0) & (F.col(pred) == 0)).alias("tn"),
        F.count_if((F.col(y) == 0) & (F.col(pred) == 1)).alias("fp"),
        F.count_if((F.col(y) == 1) & (F.col(pred) == 0)).alias("fn"),
        F.count_if((F.col(y) == 1) & (F.col(pred) == 1)).alias("tp"),
    )
    neg = F.col("tn") + F.col("fp")
    pos = F.col("fn") + F.col("tp")
    return c.select(
        *group, "tn", "fp", "fn", "tp",
        safe_div(F.col("tn"), neg).alias("tnr"),
        safe_div(F.col("fp"), neg).alias("fpr"),
        safe_div(F.col("fn"), pos).alias("fnr"),
        safe_div(F.col("tp"), pos).alias("tpr"),
    )


def threshold_metrics_from_counts(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    """I3 from counts: zero_division = 0; balanced accuracy over the classes present in y."""
    pos = fn + tp
    neg = tn + fp
    recall = zero_div(tp, pos)
    precision = zero_div(tp, tp + fp)
    f1 = zero_div(2 * tp, 2 * tp + fp + fn)
    tnr = tn / neg
    bal = (
        F.when((pos > 0) & (neg > 0), (tp / pos + tnr) / 2)
        .when(pos > 0, tp / pos)
        .when(neg > 0, tnr)
    )
    return {
        "accuracy": (tn + tp) / (tn + fp + fn + tp),
        "precision": precision,
        "recall": recall,
        "f1": f1,
        "balanced_accuracy": bal,
    }


def threshold_metrics(scored: DataFrame, group: list[str]) -> DataFrame:
    c = confusion(scored, group)
    m = threshold_metrics_from_counts(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp"))
    return c.select(*group, "tn", "fp", "fn", "tp", *[v.alias(k) for k, v in m.items()])


def brier(scored: DataFrame, group: list[str]) -> DataFrame:
    """I4: mean squared distance between score and label."""
    d = F.col("score") - F.col("y")
    return scored.groupBy(*group).agg(F.avg(d * d).alias("brier_score_loss"), F.count(F.lit(1)).alias("n"))


def roc_auc(scored: DataFrame, group: list[str]) -> DataFrame:
    """ROC-AUC with ties counted 1/2; null when a class is missing."""
    rs = rank_sums(scored.select(*group, F.col("score").alias("v"), "y"), group)
    return rs.select(
        *group,
        F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u") / (F.col("n_pos") * F.col("n_neg"))).alias("roc_auc"),
    )


def _cumulative_desc(scored: DataFrame, group: list[str]) -> DataFrame:
    """(group, score, npos, nneg, tp, fp) with tp/fp = counts with score >= this score."""
    g = scored.groupBy(*group, "score").agg(
        F.sum("y").cast("double").alias("npos"), F.sum(1 - F.col("y")).cast("double").alias("nneg")
    )
    pre = value_prefix(g, group, "score", ["npos", "nneg"], descending=True)
    return pre.withColumn("tp", F.col("npos_before") + F.col("npos")).withColumn("fp", F.col("nneg_before") + F.col("nneg"))


def average_precision(scored: DataFrame, group: list[str]) -> DataFrame:
    """Step AP = sum over distinct scores (descending) of (R_i - R_i-1) * P_i."""
    c = _cumulative_desc(scored, group)
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    agg = c.groupBy(*group).agg(F.sum(F.col("npos") * prec).alias("_s"), F.sum("npos").alias("_p"))
    return agg.select(*group, F.when(F.col("_p") > 0, F.col("_s") / F.col("_p")).alias("average_precision"))


def curves(scored: DataFrame, group: list[str]) -> DataFrame:
    """One point per distinct score threshold: precision, recall, fpr, tpr (plus prevalence)."""
    c = _cumulative_desc(scored, group)
    tot = scored.groupBy(*group).agg(F.sum("y").cast("double").alias("P"), F.sum(1 - F.col("y")).cast("double").alias("N"))
    j = c.join(F.broadcast(tot), group) if group else c.crossJoin(tot)
    return j.select(
        *group,
        F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        safe_div(F.col("tp"), F.col("P")).alias("recall"),
        safe_div(F.col("fp"), F.col("N")).alias("fpr"),
        safe_div(F.col("tp"), F.col("P")).alias("tpr"),
        (F.col("P") / (F.col("P") + F.col("N"))).alias("chance"),
    )


def fold_metrics(scored: DataFrame, group: list[str]) -> DataFrame:
    """I8: n_test, n_pos and the eight metrics per group (model, rep, fold)."""
    # one grouped table: rows of equal score once, their counts above and below from one prefix, every metric from one sum over it
    g = scored.groupBy(*group, "score").agg(
        F.sum("y").cast("double").alias("npos"),
        F.sum(1 - F.col("y")).cast("double").alias("nneg"),
        F.count_if((F.col("y") == 0) & (F.col("pred") == 1)).alias("s_fp"),
        F.count_if((F.col("y") == 1) & (F.col("pred") == 1)).alias("s_tp"),
    )
    pre = value_prefix(g, group, "score", ["npos", "nneg"], descending=True)
    above, tp = F.col("nneg_before") + F.col("nneg"), F.col("npos_before") + F.col("npos")
    t = pre.groupBy(*group).agg(
        F.sum("npos").alias("P"),
        F.sum("nneg").alias("N"),
        F.sum("s_fp").alias("fp"),
        F.sum("s_tp").alias("tp"),
        F.sum(F.col("npos") * tp / (tp + above)).alias("_ap"),
        F.sum(F.col("npos") * (F.col("nneg_before") + F.col("nneg") / 2)).alias("_beaten"),
        F.sum(F.col("npos") * (F.col("score") - 1) * (F.col("score") - 1) + F.col("nneg") * F.col("score") * F.col("score")).alias("_sq"),
    )
    pos, neg, n = F.col("P"), F.col("N"), F.col("P") + F.col("N")
    m = threshold_metrics_from_counts((neg - F.col("fp")).cast("long"), F.col("fp"), (pos - F.col("tp")).cast("long"), F.col("tp"))
    return t.select(
        *group,
        n.cast("long").alias("n_test"),
        pos.cast("long").alias("n_pos"),
        *[v.alias(k) for k, v in m.items()],
        (F.col("_sq") / n).alias("brier_score_loss"),
        F.when(pos > 0, F.col("_ap") / pos).alias("average_precision"),
        F.when((pos > 0) & (neg > 0), 1 - F.col("_beaten") / (pos * neg)).alias("roc_auc"),
    )


def metrics_long(fm: DataFrame, group: list[str]) -> DataFrame:
    """Unpivot the fold-metric table to (group..., metric, value)."""
    return fm.select(*group, *METRIC_NAMES).unpivot(group, list(METRIC_NAMES), "metric", "value")


def wilson_ci(counts: DataFrame, k: str, n: str, z: float = Z_975) -> DataFrame:
    """Wilson interval of k successes over n per row; n = 0 -> null."""
    lo, hi = wilson(F.col(k).cast("double"), F.col(n).cast("double"), z)
    return counts.withColumn("ci_low", lo).withColumn("ci_high", hi)


def oof_confusion(scored: DataFrame, group: list[str]) -> DataFrame:
    """Aggregate out-of-fold confusion, recall, accuracy and recall's Wilson interval."""
    c = confusion(scored, group)
    pos = F.col("fn") + F.col("tp")
    out = c.select(
        *group, "tn", "fp", "fn", "tp",
        (F.col("tn") + F.col("fp")).alias("n_neg"), pos.alias("n_pos"),
        safe_div(F.col("tp"), pos).alias("recall"),
        ((F.col("tn") + F.col("tp")) / (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))).alias("accuracy"),
    )
    return wilson_ci(out, "tp", "n_pos")


def bootstrap_ci(values: DataFrame, group: list[str], order: list[str], n_boot: int = 2000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Percentile bootstrap CI of the mean of a small set of values per group.

    NaN / null values are dropped; each replicate draws m indices with md5-derived
    uniforms; replicate means -> percentiles (linear).  The values table is tiny
    (folds x metrics), only the B x m draws are generated, map-side.
    """
    from pyspark.sql import Window

    v = values.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    w = Window.partitionBy(*group).orderBy(*order)
    v = v.withColumn("idx", F.row_number().over(w) - 1)
    m = v.groupBy(*group).agg(F.count(F.lit(1)).alias("m"))
    gkey = F.concat_ws("|", *[F.col(g).cast("string") for g in group])
    draws = (
        m.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        .withColumn("_u", md5_uniform(F.lit(str(seed)), gkey, F.col("b").cast("string"), F.col("i").cast("string")))
        .withColumn("idx", F.floor(F.col("_u") * F.col("m")).cast("int"))
    )
    j = draws.join(F.broadcast(v.select(*group, "idx", "value")), [*group, "idx"])
    means = j.groupBy(*group, "b").agg(F.avg("value").alias("mean_b"))
    return means.groupBy(*group).agg(
        F.percentile("mean_b", F.lit(alpha / 2)).alias("ci_low"),
        F.percentile("mean_b", F.lit(1 - alpha / 2)).alias("ci_high"),
    )


def model_summary(fm_long: DataFrame, model_order: dict[str, int], n_boot: int = 2000, seed: int = 42) -> DataFrame:
    """NaN-skipping mean + bootstrap CI per (model, metric), with the report order column."""
    mean = fm_long.filter(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("model", "metric").agg(F.avg("value").alias("mean"))
    ci = bootstrap_ci(fm_long, ["model", "metric"], ["rep", "fold"], n_boot, seed)
    order = F.create_map(*[x for k, i in model_order.items() for x in (F.lit(k), F.lit(i))])
    return mean.join(ci, ["model", "metric"], "left").withColumn("model_order", order[F.col("model")])


def best_model(summary: DataFrame) -> DataFrame:
    """Model with the highest mean average precision; first in report order on ties."""
    ap = summary.filter(F.col("metric") == "average_precision")
    return ap.agg(
        F.max_by("model", F.struct(F.col("mean"), -F.col("model_order"))).alias("best_model"),
        F.max("mean").alias("best_ap"),
    )


def beats_dummy(summary: DataFrame, dummies: tuple[str, ...] = ("dummy_most_frequent", "dummy_majority", "dummy_stratified")) -> DataFrame:
    """Each non-dummy model's mean AP against the best dummy's."""
    ap = summary.filter(F.col("metric") == "average_precision")
    d = ap.filter(F.col("model").isin(*dummies)).agg(F.max("mean").alias("best_dummy_ap"))
    return ap.filter(~F.col("model").isin(*dummies)).crossJoin(d).select(
        "model", F.col("mean").alias("ap"), "best_dummy_ap", (F.col("mean") > F.col("best_dummy_ap")).alias("beats_dummies")
    )
