"""C: exploratory profile -- descriptive table, missingness, anomalies, univariate AUC, balance,
correlation and per-class distributions.

All per-attribute work runs on one long ``(row_id, attr, v)`` frame produced by
``unpivot``, so k attributes cost one scan, not k.  Exact order statistics use
the two-level prefix kernel instead of collecting a group's values into one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rarefold.functions.columns import nan_to_null
from rarefold.functions.ranks import value_prefix
from rarefold.functions.stats import EXACT_GROUP, erfc_two_sided_p, mann_whitney_exact_udf
from rarefold.operators.prep import exact_quantiles_counted
from rarefold.spec import DatasetSpec


def long_form(df: DataFrame, attrs: list[str], ids: list[str] | None = None) -> DataFrame:
    """(ids..., attr, v double) -- one row per (row, attribute)."""
    ids = ids or []
    cast = df.select(*ids, *[nan_to_null(F.col(a).cast("double")).alias(a) for a in attrs])
    return cast.unpivot(ids, attrs, "attr", "v")


def exact_quantiles(long: DataFrame, group: list[str], qs: list[float], v: str = "v") -> DataFrame:
    """Linear-interpolated quantiles (numpy default) per group, exact, without a per-group sort.

    Returns (group..., q, value, n).  Nulls are ignored.
    """
    return exact_quantiles_counted(long.filter(F.col(v).isNotNull()).groupBy(*group, v).agg(F.count(F.lit(1)).alias("c")), group, qs, v)


def descriptive_table(df: DataFrame, attrs: list[str]) -> DataFrame:
    """N, nulls, % nulls, min, max, mean, exact median, sd (ddof 1), bias-corrected skew."""
    long = long_form(df, attrs)
    n_rows = F.count(F.lit(1))
    n = F.count("v")
    g1 = F.skewness("v")
    stats = long.groupBy("attr").agg(
        n.alias("n"),
        (n_rows - n).alias("nulls"),
        (100.0 * (n_rows - n) / n_rows).alias("pct_nulls"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("sd"),
        F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
    )
    med = exact_quantiles(long, ["attr"], [0.5]).select("attr", F.col("value").alias("median"))
    return stats.join(med, "attr", "left")


def present(df: DataFrame, attrs: list[str]) -> DataFrame:
    """NaN read as null in the attributes: the entrance of every operator that doesn't go through ``long_form``."""
    return df.withColumns({a: nan_to_null(F.col(a)) for a in attrs if isinstance(df.schema[a].dataType, (T.DoubleType, T.FloatType))})


def nulls_by_column(df: DataFrame, attrs: list[str]) -> DataFrame:
    """Null count per attribute (long form)."""
    df = present(df, attrs)
    wide = df.agg(*[F.count_if(F.col(a).isNull()).alias(a) for a in attrs])
    return wide.unpivot([], attrs, "attr", "nulls")


def _row_nulls(attrs: list[str]):
    return sum((F.col(a).isNull().cast("int") for a in attrs), F.lit(0))


def nulls_per_row_hist(df: DataFrame, attrs: list[str]) -> DataFrame:
    """C4: rows by number of nulls in the row (only counts > 0)."""
    return (
        present(df, attrs).select(_row_nulls(attrs).alias("n_null"))
        .filter(F.col("n_null") > 0)
        .groupBy("n_null")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def missingness_summary(df: DataFrame, attrs: list[str]) -> DataFrame:
    """Total nulls, affected rows, max nulls in one row, overlap flag."""
    k = _row_nulls(attrs)
    return present(df, attrs).select(k.alias("k")).agg(
        F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("total_nulls"),
        F.count_if(F.col("k") > 0).alias("rows_affected"),
        F.coalesce(F.max("k"), F.lit(0)).alias("max_in_row"),
        F.coalesce(F.max("k") > 1, F.lit(False)).alias("overlap"),
    )


def nulls_by_class(df: DataFrame, attrs: list[str], target: str) -> DataFrame:
    """Per class: size, rows with >= 1 null, % of the class (null targets dropped)."""
    k = _row_nulls(attrs)
    return (
        present(df, attrs).filter(F.col(target).isNotNull())
        .groupBy(F.col(target).cast("string").alias("class"))
        .agg(F.count(F.lit(1)).alias("n_class"), F.count_if(k > 0).alias("rows_with_nulls"))
        .withColumn("pct_of_class", 100.0 * F.col("rows_with_nulls") / F.col("n_class"))
    )


def missingness_reading(df: DataFrame, attrs: list[str], target: str) -> DataFrame:
    """Narrative sentence from the counts (one row)."""
    s = missingness_summary(df, attrs)
    clean = (
        nulls_by_class(df, attrs, target)
        .filter(F.col("rows_with_nulls") == 0)
        .agg(F.array_sort(F.collect_list("class")).alias("clean_classes"))
    )
    overlap = F.when(F.col("overlap"), F.lit("Rows carry nulls in several columns.")).otherwise(
        F.lit("Nulls never overlap across columns.")
    )
    base = F.format_string("%d nulls over %d rows; no row has more than %d. ", F.col("total_nulls"), F.col("rows_affected"), F.col("max_in_row"))
    tail = F.when(
        F.size("clean_classes") > 0,
        F.concat(F.lit(" No row of class "), F.array_join("clean_classes", ", "), F.lit(" has nulls: missingness is not random with respect to the target.")),
    ).otherwise(F.lit(""))
    return s.crossJoin(clean).select(
        "total_nulls", "rows_affected", "max_in_row", "overlap",
        F.concat(base, overlap, tail).alias("reading"),
    )


def physical_anomalies(df: DataFrame, ranges: dict[str, tuple[float, float]], key: str = "row_id") -> DataFrame:
    """Impossible values in long form, joined to the (tiny, fixed) ranges table by broadcast."""
    attrs = [a for a in ranges if a in df.columns]
    if not attrs:
        return df.sparkSession.createDataFrame([], f"{key} string, attr string, value double, low double, high double, violation string")
    spark = df.sparkSession
    rng = spark.createDataFrame([(a, float(lo), float(hi)) for a, (lo, hi) in ranges.items() if a in attrs], "attr string, low double, high double")
    long = long_form(df, attrs, [key])
    j = long.join(F.broadcast(rng), "attr").filter(F.col("v").isNotNull() & ((F.col("v") < F.col("low")) | (F.col("v") > F.col("high"))))
    return j.select(
        key, "attr", F.col("v").alias("value"), "low", "high",
        F.when(F.col("v") < F.col("low"), F.lit("below minimum")).otherwise(F.lit("above maximum")).alias("violation"),
    )


def rank_sums(long: DataFrame, group: list[str], v: str = "v", y: str = "y") -> DataFrame:
    """Per group: U of the positives (ties 1/2), class sizes and the tie term sum(t^3 - t).

    Pre-aggregates to distinct (group, value) before the prefix kernel.
    """
    g = (
        long.filter(F.col(v).isNotNull() & F.col(y).isNotNull())
        .groupBy(*group, v)
        .agg(F.sum(F.col(y)).cast("double").alias("npos"), F.sum(1 - F.col(y)).cast("double").alias("nneg"))
    )
    pre = value_prefix(g, group, v, ["nneg"])
    t = F.col("npos") + F.col("nneg")
    return pre.groupBy(*group).agg(
        F.sum(F.col("npos") * (F.col("nneg_before") + F.col("nneg") / 2)).alias("u"),
        F.sum("npos").alias("n_pos"),
        F.sum("nneg").alias("n_neg"),
        F.sum(t * t * t - t).alias("tie"),
    )


def univariate_auc(df: DataFrame, spec: DatasetSpec, with_p: bool = True) -> DataFrame:
    """AUC = U/(n+ n-) per attribute, class means, z of the tie/continuity-corrected
    normal approximation, two-sided p, direction, significance and rank by distance from 1/2.

    The p-value is exact where no value repeats and the smaller class has at most EXACT_GROUP rows, else that of z.
    """
    attrs = spec.numeric_attributes()
    y = (F.col(spec.target).cast("string") == spec.positive_label).cast("int")
    base = present(df, attrs).select(y.alias("y"), *[F.col(a).cast("double").alias(a) for a in attrs])
    long = base.unpivot(["y"], attrs, "attr", "v")
    rs = rank_sums(long, ["attr"])
    means = long.filter(F.col("v").isNotNull()).groupBy("attr").agg(
        F.avg(F.when(F.col("y") == 1, F.col("v"))).alias("mean_pos"),
        F.avg(F.when(F.col("y") == 0, F.col("v"))).alias("mean_neg"),
    )
    n1, n2 = F.col("n_pos"), F.col("n_neg")
    N = n1 + n2
    mu = n1 * n2 / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((N + 1) - F.col("tie") / (N * (N - 1))))
    z = F.when(sigma > 0, (F.abs(F.col("u") - mu) - 0.5) / sigma)
    out = rs.join(means, "attr").select(
        "attr",
        n1.cast("long").alias("n_pos"),
        n2.cast("long").alias("n_neg"),
        "mean_pos",
        "mean_neg",
        (F.col("u") / (n1 * n2)).alias("auc"),
        F.col("u").alias("u"),
        z.alias("z"),
        "tie",
    )
    # Strongest first; one row an attribute, so this order is a small one
    out = out.withColumn("rank", F.row_number().over(Window.orderBy(F.abs(F.col("auc") - 0.5).desc_nulls_last(), "attr")))
    out = out.withColumn("direction", F.when(F.col("auc") >= 0.5, F.lit("direct")).otherwise(F.lit("inverse")))
    if with_p:
        approximate = F.least(F.lit(1.0), erfc_two_sided_p(F.greatest(F.col("z"), F.lit(0.0))))
        exact = (F.col("tie") == 0) & (F.least("n_pos", "n_neg") <= EXACT_GROUP)
        out = out.withColumn("p_exact", exact).withColumn("p_value", F.when(exact, mann_whitney_exact_udf("u", "n_pos", "n_neg")).otherwise(approximate))
        out = out.withColumn("significant_5pct", F.col("p_value") < 0.05)
    return out.drop("tie")


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """C13 (per class): counts with nulls stringified to the class 'nan'."""
    cls = F.coalesce(F.col(target).cast("string"), F.lit("nan"))
    return df.groupBy(cls.alias("class")).agg(F.count(F.lit(1)).alias("n_class"))


def class_balance(df: DataFrame, target: str, positive: str) -> DataFrame:
    """N, classes, nulls in target, positives, prevalence, majority class (first in label
    order on ties) and the trivial majority accuracy -- one row."""
    counts = class_counts(df, target)
    nulls = df.agg(F.count_if(F.col(target).isNull()).alias("nulls_in_target"))
    agg = counts.agg(
        F.sum("n_class").alias("n"),
        F.count(F.lit(1)).alias("n_classes"),
        F.coalesce(F.sum(F.when(F.col("class") == positive, F.col("n_class"))), F.lit(0)).alias("n_positive"),
        F.max("n_class").alias("n_majority"),
    )
    # majority: highest count, ties to the first label in sorted order
    first_major = counts.join(agg.select("n_majority"), F.col("n_class") == F.col("n_majority")).agg(F.min("class").alias("majority_class"))
    return agg.crossJoin(first_major).crossJoin(nulls).select(
        F.col("n").cast("long"),
        "n_classes",
        "nulls_in_target",
        F.col("n_positive").cast("long"),
        (F.col("n_positive") / F.col("n")).alias("prevalence"),
        "majority_class",
        (F.col("n_majority") / F.col("n")).alias("majority_accuracy"),
    )


def correlation_matrix(df: DataFrame, attrs: list[str]) -> DataFrame:
    """C14: Pearson r for every ordered pair, pairwise-complete rows, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(attrs) for b in attrs[i + 1:]]
    cast = present(df, attrs).select(*[F.col(a).cast("double").alias(a) for a in attrs])
    wide = cast.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    spark = df.sparkSession
    names = spark.createDataFrame([(str(i), a, b) for i, (a, b) in enumerate(pairs)], "k string, a string, b string")
    long = wide.unpivot([], [str(i) for i in range(len(pairs))], "k", "r").join(F.broadcast(names), "k")
    upper = long.select("a", "b", "r")
    lower = long.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")
    diag = spark.createDataFrame([(a, a, 1.0) for a in attrs], "a string, b string, r double")
    return upper.unionByName(lower).unionByName(diag)


def max_abs_corr(df: DataFrame, attrs: list[str]) -> DataFrame:
    """Largest |r| off the diagonal, its pair (in attribute order) and signed r."""
    order = {a: i for i, a in enumerate(attrs)}
    cm = correlation_matrix(df, attrs)
    pos = F.create_map(*[x for a, i in order.items() for x in (F.lit(a), F.lit(i))])
    off = cm.filter((F.col("a") != F.col("b")) & F.col("r").isNotNull() & ~F.isnan("r"))
    off = off.withColumn("ia", pos[F.col("a")]).withColumn("ib", pos[F.col("b")]).filter(F.col("ia") < F.col("ib"))
    best = off.agg(
        F.max_by(F.struct("a", "b", "r"), F.struct(F.abs("r"), -F.col("ia"), -F.col("ib"))).alias("m"),
        F.max(F.abs("r")).alias("max_abs_r"),
    )
    return best.select(F.col("m.a").alias("attr_a"), F.col("m.b").alias("attr_b"), F.col("m.r").alias("r"), "max_abs_r")


def class_histogram(df: DataFrame, attrs: list[str], target: str, bins: int = 18) -> DataFrame:
    """Equal bins over the pooled min-max per attribute, last bin closed, weight 1/n_class."""
    base = present(df, attrs).select(F.col(target).cast("string").alias("class"), *[F.col(a).cast("double").alias(a) for a in attrs])
    long = base.unpivot(["class"], attrs, "attr", "v").filter(F.col("v").isNotNull() & F.col("class").isNotNull())
    rng = long.groupBy("attr").agg(F.min("v").alias("mn"), F.max("v").alias("mx"))
    ncls = long.groupBy("attr", "class").agg(F.count(F.lit(1)).alias("n_class"))
    width = (F.col("mx") - F.col("mn")) / bins
    b = F.when(F.col("mx") == F.col("mn"), F.lit(0)).otherwise(F.least(F.floor((F.col("v") - F.col("mn")) / width), F.lit(bins - 1)))
    h = long.join(F.broadcast(rng), "attr").withColumn("bin", b.cast("int")).groupBy("attr", "class", "bin").agg(F.count(F.lit(1)).alias("count"))
    return h.join(ncls, ["attr", "class"]).select("attr", "class", "bin", "count", (F.col("count") / F.col("n_class")).alias("weight"))


def class_boxplot(df: DataFrame, attrs: list[str], target: str) -> DataFrame:
    """C17: quartiles per (attr, class), 1.5 IQR whiskers snapped to data, outlier count."""
    base = present(df, attrs).select(F.col(target).cast("string").alias("class"), *[F.col(a).cast("double").alias(a) for a in attrs])
    long = base.unpivot(["class"], attrs, "attr", "v").filter(F.col("v").isNotNull() & F.col("class").isNotNull())
    q = exact_quantiles(long, ["attr", "class"], [0.25, 0.5, 0.75])
    qw = q.groupBy("attr", "class").agg(
        F.max(F.when(F.col("q") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("median"),
        F.max(F.when(F.col("q") == 0.75, F.col("value"))).alias("q3"),
    )
    iqr = F.col("q3") - F.col("q1")
    lo_f = F.col("q1") - 1.5 * iqr
    hi_f = F.col("q3") + 1.5 * iqr
    j = long.join(F.broadcast(qw), ["attr", "class"])  # one row an attribute and class: the rows stay where they were read
    return j.groupBy("attr", "class", "q1", "median", "q3").agg(
        F.min(F.when(F.col("v") >= lo_f, F.col("v"))).alias("whisker_lo"),
        F.max(F.when(F.col("v") <= hi_f, F.col("v"))).alias("whisker_hi"),
        F.count_if((F.col("v") < lo_f) | (F.col("v") > hi_f)).alias("n_outliers"),
    )


def table_shape(df: DataFrame, target: str) -> DataFrame:
    """Rows, columns, distinct labels, exactly-two-classes flag."""
    ncols = len(df.columns)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.col(target)).alias("n_labels")).select(
        "n_rows", F.lit(ncols).alias("n_columns"), "n_labels", (F.col("n_labels") == 2).alias("two_classes")
    )


PI = math.pi
