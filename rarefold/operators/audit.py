"""D: plausibility audit -- is the table likely synthetic?

Two strong signatures decide (mutual independence of attributes, too-regular
missingness); the last-digit uniformity test is supporting evidence only.
Every step is an aggregate over the table; p-values are finished on the
k-row results by small pandas UDFs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefold.functions.stats import chi2_sf_udf, hypergeom_cdf_udf
from rarefold.operators import profile

# Correlation threshold of the independence signature, alpha of the digit test,
# largest decimal resolution probed, numpy's default relative tolerance.
MIN_CORRELATION = 0.15
ALPHA_UNIFORM = 0.05
MAX_DECIMALS = 4
ATOL = 1e-9
RTOL = 1e-5


def audit_correlation(df: DataFrame, attrs: list[str], threshold: float = MIN_CORRELATION) -> DataFrame:
    """Independent iff max |r| < threshold (no pair -> false), with evidence text."""
    m = profile.max_abs_corr(df, attrs)
    spark = df.sparkSession
    one = spark.range(1).select(F.lit(threshold).alias("threshold"))
    j = one.join(m, how="left")
    indep = F.coalesce(F.col("max_abs_r") < F.col("threshold"), F.lit(False))
    return j.select(
        "attr_a", "attr_b", "r", "max_abs_r", "threshold",
        indep.alias("independent"),
        F.format_string(
            "max |r| = %.4f between %s and %s (%s threshold %.2f)",
            F.col("max_abs_r"), F.col("attr_a"), F.col("attr_b"),
            F.when(indep, F.lit("below")).otherwise(F.lit("above")), F.col("threshold"),
        ).alias("evidence"),
    )


def audit_missingness(df: DataFrame, attrs: list[str]) -> DataFrame:
    """Equal null count in every affected column (>= 1 affected) and no row overlap."""
    per_col = profile.nulls_by_column(df, attrs)
    eq = per_col.filter(F.col("nulls") > 0).agg(
        F.count(F.lit(1)).alias("affected_columns"), F.count_distinct("nulls").alias("distinct_counts")
    )
    summ = profile.missingness_summary(df, attrs)
    equal = (F.col("affected_columns") > 0) & (F.col("distinct_counts") == 1)
    return eq.crossJoin(summ).select(
        "affected_columns", "total_nulls", "max_in_row",
        equal.alias("equal_per_column"),
        (~F.col("overlap")).alias("no_overlap"),
        (equal & ~F.col("overlap")).alias("suspicious_regularity"),
    )


def audit_hypergeom(df: DataFrame, attrs: list[str], target: str, positive: str) -> DataFrame:
    """D3: P(X <= observed) under Hypergeometric(N, N+, total nulls); expected = nulls * prevalence."""
    k = sum((F.col(a).isNull().cast("int") for a in attrs), F.lit(0))
    y = F.col(target).cast("string") == positive
    agg = df.select(k.alias("k"), y.alias("y")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("y")).alias("n_positive"),
        F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("total_nulls"),
        F.count_if(F.col("y") & (F.col("k") > 0)).alias("observed"),
    )
    return agg.select(
        "n", "n_positive", "total_nulls", "observed",
        (F.col("total_nulls") * F.col("n_positive") / F.col("n")).alias("expected"),
        hypergeom_cdf_udf("observed", "n", "n_positive", "total_nulls").alias("p_value"),
    )


def _decimals_long(df: DataFrame, attrs: list[str], int_attrs: set[str]) -> DataFrame:
    long = profile.long_form(df, attrs).filter(F.col("v").isNotNull())
    return long.withColumn("is_int", F.col("attr").isin(*int_attrs) if int_attrs else F.lit(False))


def decimal_resolution(df: DataFrame, attrs: list[str], int_attrs: set[str]) -> DataFrame:
    """Smallest d <= 4 with all |bround(v, d) - v| <= atol + rtol |v|; ints -> 0; empty -> 0."""
    long = _decimals_long(df, attrs, int_attrs)
    oks = [
        F.bool_and(F.abs(F.bround(F.col("v"), d) - F.col("v")) <= ATOL + RTOL * F.abs(F.col("v"))).alias(f"ok{d}")
        for d in range(MAX_DECIMALS + 1)
    ]
    agg = long.groupBy("attr").agg(F.max("is_int").alias("is_int"), *oks)
    d = F.lit(MAX_DECIMALS)
    for i in reversed(range(MAX_DECIMALS + 1)):
        d = F.when(F.col(f"ok{i}"), F.lit(i)).otherwise(d)
    spark = df.sparkSession
    all_attrs = spark.createDataFrame([(a,) for a in attrs], "attr string")
    return all_attrs.join(agg, "attr", "left").select(
        "attr", F.when(F.coalesce(F.col("is_int"), F.lit(False)), F.lit(0)).otherwise(F.coalesce(d, F.lit(0))).alias("decimals")
    )


def last_digit_counts(df: DataFrame, attrs: list[str], int_attrs: set[str]) -> DataFrame:
    """Counts of the last recorded digit 0-9 per attribute, zeros kept (floor-mod)."""
    long = _decimals_long(df, attrs, int_attrs)
    dec = decimal_resolution(df, attrs, int_attrs)
    scaled = F.bround(F.col("v") * F.pow(F.lit(10.0), F.col("decimals")), 0).cast("long")
    digits = long.join(F.broadcast(dec), "attr").select("attr", F.pmod(scaled, F.lit(10)).cast("int").alias("digit"))
    counts = digits.groupBy("attr", "digit").agg(F.count(F.lit(1)).alias("count"))
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, d) for a in attrs for d in range(10)], "attr string, digit int")
    return grid.join(counts, ["attr", "digit"], "left").select("attr", "digit", F.coalesce("count", F.lit(0)).alias("count"))


def digit_chi2(df: DataFrame, attrs: list[str], int_attrs: set[str]) -> DataFrame:
    """Chi-square statistic of the digit counts against uniform (9 df)."""
    c = last_digit_counts(df, attrs, int_attrs)
    tot = c.groupBy("attr").agg(F.sum("count").alias("n"))
    e = F.col("n") / 10.0
    return (
        c.join(tot, "attr")
        .groupBy("attr", "n")
        .agg(F.sum(F.when(e > 0, (F.col("count") - e) * (F.col("count") - e) / e)).alias("chi2"))
        .join(decimal_resolution(df, attrs, int_attrs), "attr")
    )


def digit_uniformity(df: DataFrame, attrs: list[str], int_attrs: set[str], alpha: float = ALPHA_UNIFORM) -> DataFrame:
    """P-value of the chi-square (9 df) and compatibility with uniform (p > alpha)."""
    x = digit_chi2(df, attrs, int_attrs)
    x = x.withColumn("p_value", chi2_sf_udf(F.col("chi2"), F.lit(9)))
    return x.withColumn("uniform", F.col("p_value") > alpha)


DIGIT_SENTENCE = "last decimal digits are compatible with uniform sampling in every attribute (weak, supporting evidence)"


def plausibility_verdict(df: DataFrame, attrs: list[str], int_attrs: set[str] = frozenset()) -> DataFrame:
    """D7: 'probably synthetic' iff both strong signatures hold; evidence list.

    The digit test never decides; it adds a sentence where every attribute with values is compatible with uniform last digits.
    """
    c = audit_correlation(df, attrs).select("independent", F.col("evidence").alias("ev_corr"))
    m = audit_missingness(df, attrs).select("suspicious_regularity", "total_nulls")
    d = digit_uniformity(df, attrs, int_attrs).agg(F.coalesce(F.bool_and("uniform"), F.lit(False)).alias("digits_uniform"))
    j = c.crossJoin(m).crossJoin(d)  # one row each
    synth = F.col("independent") & F.col("suspicious_regularity")
    return j.select(
        "independent",
        "suspicious_regularity",
        "digits_uniform",
        synth.alias("probably_synthetic"),
        F.when(synth, F.lit("probably synthetic")).otherwise(F.lit("compatible with real data")).alias("verdict"),
        F.concat_ws(" | ", F.col("ev_corr"), F.format_string("%d nulls", F.col("total_nulls")), F.when(F.col("digits_uniform"), F.lit(DIGIT_SENTENCE))).alias("evidence"),
    )
