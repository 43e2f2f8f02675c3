"""N: cross-dataset comparison -- one job over the union of the datasets' scored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefold.functions.cache import keep
from rarefold.functions.columns import wilson
from rarefold.operators import decision
from rarefold.spec import CostMatrix


def dataset_comparison(scored: DataFrame, costs: CostMatrix = CostMatrix()) -> DataFrame:
    """Per dataset (column ``dataset``): n, positives, prevalence, majority accuracy,
    cost-optimal decision threshold, recall at it with its Wilson interval, costs and saving.

    ``half`` (0 / 1) splits each dataset: a half is decided with the threshold chosen on the other one, so no
    row is scored with a threshold it helped to choose. ``threshold`` is the median of the two."""
    train = scored.select("dataset", (1 - F.col("half")).alias("half"), "y", "score")
    opt = keep(decision.optimal_threshold(train, ["dataset", "half"], costs).select("dataset", "half", F.col("optimal_threshold").alias("t")))  # read twice, a row a half
    j = scored.join(F.broadcast(opt), ["dataset", "half"])
    d = (F.col("score") >= F.col("t")).cast("int")
    d5 = (F.col("score") >= 0.5).cast("int")
    agg = j.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("y").cast("long").alias("n_pos"),
        F.count_if((F.col("y") == 1) & (d == 1)).alias("tp"),
        F.count_if((F.col("y") == 0) & (d == 1)).alias("fp"),
        F.count_if((F.col("y") == 1) & (d5 == 1)).alias("tp_05"),
        F.count_if((F.col("y") == 0) & (d5 == 1)).alias("fp_05"),
    ).join(F.broadcast(opt.groupBy("dataset").agg(F.avg("t").alias("threshold"))), "dataset")
    fn = F.col("n_pos") - F.col("tp")
    fn5 = F.col("n_pos") - F.col("tp_05")
    tn = F.col("n") - F.col("n_pos") - F.col("fp")
    tn5 = F.col("n") - F.col("n_pos") - F.col("fp_05")
    cost_t = decision.cost_expr(tn, F.col("fp"), fn, F.col("tp"), costs)
    cost_5 = decision.cost_expr(tn5, F.col("fp_05"), fn5, F.col("tp_05"), costs)
    lo, hi = wilson(F.col("tp").cast("double"), F.col("n_pos").cast("double"))
    prev = F.col("n_pos") / F.col("n")
    return agg.select(
        "dataset", "n", "n_pos", prev.alias("prevalence"), F.greatest(prev, 1 - prev).alias("majority_accuracy"),
        "threshold", "tp", (F.col("tp") / F.col("n_pos")).alias("recall"), lo.alias("ci_low"), hi.alias("ci_high"),
        cost_5.alias("cost_at_05"), cost_t.alias("cost_at_threshold"),
        F.when(cost_5 != 0, 100.0 * (cost_5 - cost_t) / cost_5).alias("saving_pct"),
    )


def report_completeness(expected: DataFrame, mart: DataFrame) -> DataFrame:
    """Every expected (dataset, section) with whether the report mart holds it and how many
    metric rows; an absent section is reported absent instead of failing downstream."""
    have = mart.groupBy("dataset", "section").agg(F.count(F.lit(1)).alias("n_rows"))
    j = expected.join(have, ["dataset", "section"], "left")
    return j.select("dataset", "section", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.col("n_rows").isNotNull().alias("present"))
