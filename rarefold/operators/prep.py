"""G: fold-safe preprocessing -- statistics fitted on each fold's training rows only.

Medians: pre-aggregate value counts per (attr, row's fold, v) once; the training
count of fold f is ``total(v) - count_f(v)``, so no row is ever copied k times
before the prefix kernel.  Means / population sd: broadcast fold expansion with
map-side partial aggregation (numerically stable central moments).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefold.functions.brackets import clean, set_ranks
from rarefold.functions.cache import keep
from rarefold.functions.columns import nan_to_null
from rarefold.functions.ranks import value_prefix
from rarefold.operators.resample import fold_expansion


def exact_quantiles_counted(cnt: DataFrame, group: list[str], qs: list[float], v: str = "v", c: str = "c") -> DataFrame:
    """Linear-interpolated quantiles from (group..., v, c) value counts (c > 0).

    Groups are attributes, classes or cells, never data: their totals, one row each, are broadcast, so no group's values meet in a task.
    """
    pre = value_prefix(cnt, group, v, [c])
    tot = pre.groupBy(*group).agg(F.sum(c).alias("n"))
    qarr = F.array(*[F.lit(float(q)) for q in qs])
    x = pre.join(F.broadcast(tot), on=group).select(*group, v, c, F.col(f"{c}_before").alias("cb"), "n", F.explode(qarr).alias("q"))
    pos = F.col("q") * (F.col("n") - 1)
    x = x.withColumn("lo", F.floor(pos)).withColumn("hi", F.ceil(pos)).withColumn("frac", pos - F.floor(pos))
    hit_lo = (F.col("cb") <= F.col("lo")) & (F.col("lo") < F.col("cb") + F.col(c))
    hit_hi = (F.col("cb") <= F.col("hi")) & (F.col("hi") < F.col("cb") + F.col(c))
    sel = x.filter(hit_lo | hit_hi).groupBy(*group, "q").agg(
        F.max(F.when(hit_lo, F.col(v))).alias("v_lo"),
        F.max(F.when(hit_hi, F.col(v))).alias("v_hi"),
        F.max("frac").alias("frac"),
        F.max("n").alias("n"),
    )
    return sel.select(*group, "q", (F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * F.col("frac")).alias("value"), "n")


def _outer_sets(folded: DataFrame, k: int) -> dict:
    reps = [r["rep"] for r in folded.select("rep").distinct().collect()]  # the repeats of the CV design
    return {(rep, o): (lambda g, rep=rep, o=o: g[0] == rep and g[1] != o) for rep in reps for o in range(k)}


def _narrow(folded: DataFrame, features: list[str]) -> DataFrame:
    """Fold and features only, stored: every pass reads them; none reads the keys that dealt the folds."""
    rows = folded.select("rep", "fold", *[clean(F.col(f)).alias(f) for f in features])
    return rows if folded.is_cached else keep(rows)


def foldwise_medians(folded: DataFrame, features: list[str], k: int) -> DataFrame:
    """G1: (rep, outer, attr, median, n_fit) -- median of each feature over the outer fold's train rows.

    Train rows are unions of folds: ``brackets.set_ranks`` counts each fold once, no row is copied."""
    folded = _narrow(folded, features)
    sets = _outer_sets(folded, k)
    found, sizes = set_ranks(folded, ["rep", "fold"], features, sets, lambda _, n: [(n - 1) // 2, n // 2])
    rows = [(rep, o, a, (found[(rep, o), a, (n - 1) // 2] + found[(rep, o), a, n // 2]) / 2, n) for rep, o in sets for a in features if (n := sizes.get(((rep, o), a), 0))]
    return folded.sparkSession.createDataFrame(rows, "rep int, outer int, attr string, median double, n_fit long")


def impute(folded_expanded: DataFrame, medians: DataFrame, features: list[str]) -> DataFrame:
    """Fill nulls of each (rep, outer) copy with that fold's train medians (broadcast: k x d rows)."""
    wide = medians.groupBy("rep", "outer").pivot("attr", features).agg(F.first("median"))
    wide = wide.select("rep", "outer", *[F.col(f).alias(f"_m_{f}") for f in features])
    j = folded_expanded.join(F.broadcast(wide), ["rep", "outer"])
    return j.select(
        *[c for c in folded_expanded.columns if c not in features],
        *[F.coalesce(F.col(f).cast("double"), F.col(f"_m_{f}")).alias(f) for f in features],
    )


def foldwise_standardize(folded: DataFrame, features: list[str], k: int) -> DataFrame:
    """(rep, outer, attr, mean, sd) of the imputed train rows, population sd, 0 -> 1."""
    x = folded = _narrow(folded, features)
    med = {(r["rep"], r["outer"], r["attr"]): r["median"] for r in foldwise_medians(x, features, k).collect()}
    mid = x.agg(*[F.coalesce(F.avg(f), F.lit(0.0)).alias(f) for f in features]).first()
    aggs = [F.count("*").alias("_n")]
    for f in features:
        d = F.col(f) - F.lit(mid[f])
        aggs += [F.count(f).alias(f"n_{f}"), F.coalesce(F.sum(d), F.lit(0.0)).alias(f"s_{f}"), F.coalesce(F.sum(d * d), F.lit(0.0)).alias(f"q_{f}")]
    parts = x.groupBy("rep", "fold").agg(*aggs).collect()  # repeats x folds rows
    rows = []
    for (rep, o), member in _outer_sets(folded, k).items():
        mine = [r for r in parts if member((r["rep"], r["fold"]))]
        n = sum(r["_n"] for r in mine)
        for f in features:
            if (rep, o, f) in med:
                have, s, q = (sum(r[f"{t}_{f}"] for r in mine) for t in "nsq")
                m = med[rep, o, f] - mid[f]
                mean = (s + (n - have) * m) / n
                sd = max((q + (n - have) * m * m) / n - mean * mean, 0.0) ** 0.5
                rows.append((rep, o, f, float(mid[f] + mean), float(sd) if sd > 1e-12 * max(1.0, abs(mid[f])) else 1.0))
    return folded.sparkSession.createDataFrame(rows, "rep int, outer int, attr string, mean double, sd double")


def naive_medians(df: DataFrame, features: list[str]) -> DataFrame:
    """G3 (counter-example): whole-table medians, leaking test rows into the fit."""
    long = df.select(*[nan_to_null(F.col(f).cast("double")).alias(f) for f in features]).unpivot([], features, "attr", "v")
    cnt = long.filter(F.col("v").isNotNull()).groupBy("attr", "v").agg(F.count(F.lit(1)).alias("c"))
    q = exact_quantiles_counted(cnt, ["attr"], [0.5])
    nulls = long.groupBy("attr").agg(F.count_if(F.col("v").isNull()).alias("filled"))
    return q.select("attr", F.col("value").alias("median"), F.col("n").alias("n_fit")).join(nulls, "attr")


def naive_fill(df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """G3 (counter-example): ``keys`` and the features, nulls and NaN filled with the whole table's medians.

    A feature without any value stays null. The medians are one row, broadcast.
    """
    wide = naive_medians(df, features).groupBy().pivot("attr", features).agg(F.first("median"))
    medians = wide.select(*[F.col(f).alias(f"_md_{f}") for f in features])
    rows = df.select(*keys, *[nan_to_null(F.col(f).cast("double")).alias(f) for f in features])
    return rows.join(F.broadcast(medians)).select(*keys, *[F.coalesce(f, f"_md_{f}").alias(f) for f in features])


def leak_audit(folded: DataFrame, k: int) -> DataFrame:
    """Rows each fold's fit saw vs the table size: must be n (k-1)/k, never n."""
    ex = fold_expansion(folded, k)
    return ex.groupBy("rep", "outer").agg(
        F.count_if(F.col("role") == "train").alias("n_fit"), F.count(F.lit(1)).alias("n_total")
    ).withColumn("leak_free", F.col("n_fit") < F.col("n_total"))


def balanced_weights(folded: DataFrame, label: str, k: int) -> DataFrame:
    """Class weight n_train / (2 n_c,train) per (rep, outer, class)."""
    ex = fold_expansion(folded, k).filter(F.col("role") == "train")
    c = ex.groupBy("rep", "outer", label).agg(F.count(F.lit(1)).alias("n_c"))
    t = c.groupBy("rep", "outer").agg(F.sum("n_c").alias("n_train"))
    return c.join(t, ["rep", "outer"]).withColumn("weight", F.col("n_train") / (2.0 * F.col("n_c")))
