"""Registered queries, section C (profile)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rarefold.operators import profile
from rarefold.plans.common import rounded, valid
from rarefold.plans.oracle_base import BASE, LONG, OBS, TAGGED, VALID, with_
from rarefold.spec import OBS as SPEC

ATTRS = SPEC.numeric_attributes()


def q_descriptive_table(spark, sf):
    return rounded(profile.descriptive_table(valid(spark, sf), ATTRS))


def q_nulls_by_column(spark, sf):
    return profile.nulls_by_column(valid(spark, sf), ATTRS)


def q_nulls_per_row_hist(spark, sf):
    return profile.nulls_per_row_hist(valid(spark, sf), ATTRS)


def q_missingness_summary(spark, sf):
    return profile.missingness_summary(valid(spark, sf), ATTRS)


def q_nulls_by_class(spark, sf):
    return rounded(profile.nulls_by_class(valid(spark, sf), ATTRS, "failure"))


def q_missingness_reading(spark, sf):
    return profile.missingness_reading(valid(spark, sf), ATTRS, "failure")


def q_physical_anomalies(spark, sf):
    from rarefold.plans.common import obs

    return rounded(profile.physical_anomalies(obs(spark, sf), SPEC.ranges()))


def q_univariate_auc(spark, sf):
    return rounded(profile.univariate_auc(valid(spark, sf), SPEC, with_p=False))


def q_mannwhitney_p(spark, sf):
    return rounded(profile.univariate_auc(valid(spark, sf), SPEC, with_p=True))


def q_class_balance(spark, sf):
    return rounded(profile.class_balance(valid(spark, sf), "failure", "yes"))


def q_class_counts(spark, sf):
    return profile.class_counts(valid(spark, sf), "failure")


def q_correlation_matrix(spark, sf):
    return rounded(profile.correlation_matrix(valid(spark, sf), ATTRS))


def q_max_abs_corr(spark, sf):
    return rounded(profile.max_abs_corr(valid(spark, sf), ATTRS))


def q_class_histogram(spark, sf):
    return rounded(profile.class_histogram(valid(spark, sf), ATTRS, "failure"))


def q_class_boxplot(spark, sf):
    return rounded(profile.class_boxplot(valid(spark, sf), ATTRS, "failure"))


def q_table_shape(spark, sf):
    v = valid(spark, sf).select("qty", "price", "disc", "tax", "line", "failure")
    return profile.table_shape(v, "failure")


QUERIES = {
    "descriptive_table": q_descriptive_table,
    "nulls_by_column": q_nulls_by_column,
    "nulls_per_row_hist": q_nulls_per_row_hist,
    "missingness_summary": q_missingness_summary,
    "nulls_by_class": q_nulls_by_class,
    "missingness_reading": q_missingness_reading,
    "physical_anomalies": q_physical_anomalies,
    "univariate_auc": q_univariate_auc,
    "mannwhitney_p": q_mannwhitney_p,
    "class_balance": q_class_balance,
    "class_counts": q_class_counts,
    "correlation_matrix": q_correlation_matrix,
    "max_abs_corr": q_max_abs_corr,
    "class_histogram": q_class_histogram,
    "class_boxplot": q_class_boxplot,
    "table_shape": q_table_shape,
}

L = with_(OBS, TAGGED, VALID, LONG)
NROW = "(SELECT CAST(qty IS NULL AS INT) + CAST(price IS NULL AS INT) + CAST(disc IS NULL AS INT) + CAST(tax IS NULL AS INT) + CAST(line IS NULL AS INT) AS k, failure FROM valid)"

CORR_PAIRS = [(a, b) for i, a in enumerate(ATTRS) for b in ATTRS[i + 1:]]
CORR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM valid" for a, b in CORR_PAIRS
)

ORACLE = {
    "descriptive_table": L
    + """SELECT attr, count(v) AS n, count(*) - count(v) AS nulls, round(100.0 * (count(*) - count(v)) / count(*), 6) AS pct_nulls,
                round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd,
                round(CASE WHEN count(v) >= 3 THEN skewness(v) END, 6) AS skew, round(quantile_cont(v, 0.5), 6) AS median
         FROM lng GROUP BY attr""",
    "nulls_by_column": L + "SELECT attr, count(*) FILTER (WHERE v IS NULL) AS nulls FROM lng GROUP BY attr",
    "nulls_per_row_hist": BASE + f"SELECT k AS n_null, count(*) AS rows FROM {NROW} WHERE k > 0 GROUP BY k",
    "missingness_summary": BASE
    + f"""SELECT CAST(coalesce(sum(k), 0) AS BIGINT) AS total_nulls, count(*) FILTER (WHERE k > 0) AS rows_affected,
                 coalesce(max(k), 0) AS max_in_row, coalesce(max(k) > 1, false) AS overlap FROM {NROW}""",
    "nulls_by_class": BASE
    + f"""SELECT failure AS class, count(*) AS n_class, count(*) FILTER (WHERE k > 0) AS rows_with_nulls,
                 round(100.0 * count(*) FILTER (WHERE k > 0) / count(*), 6) AS pct_of_class
          FROM {NROW} WHERE failure IS NOT NULL GROUP BY failure""",
    "missingness_reading": BASE
    + f"""SELECT total_nulls, rows_affected, max_in_row, overlap,
                 printf('%d nulls over %d rows; no row has more than %d. ', total_nulls, rows_affected, max_in_row)
                 || CASE WHEN overlap THEN 'Rows carry nulls in several columns.' ELSE 'Nulls never overlap across columns.' END
                 || CASE WHEN clean IS NOT NULL AND len(clean) > 0 THEN ' No row of class ' || array_to_string(clean, ', ')
                         || ' has nulls: missingness is not random with respect to the target.' ELSE '' END AS reading
          FROM (SELECT CAST(coalesce(sum(k), 0) AS BIGINT) AS total_nulls, count(*) FILTER (WHERE k > 0) AS rows_affected,
                       coalesce(max(k), 0) AS max_in_row, coalesce(max(k) > 1, false) AS overlap FROM {NROW}),
               (SELECT list_sort(list(failure)) AS clean FROM (SELECT failure FROM {NROW} GROUP BY failure HAVING count(*) FILTER (WHERE k > 0) = 0))""",
    "physical_anomalies": with_(OBS)
    + """SELECT row_id, attr, round(v, 6) AS value, round(low, 6) AS low, round(high, 6) AS high,
                CASE WHEN v < low THEN 'below minimum' ELSE 'above maximum' END AS violation
         FROM (SELECT row_id, 'qty' AS attr, qty AS v, 0.0::DOUBLE AS low, 49.0::DOUBLE AS high FROM obs
               UNION ALL SELECT row_id, 'disc', disc, 0.0, 1.0 FROM obs
               UNION ALL SELECT row_id, 'tax', tax, 0.0, 1.0 FROM obs
               UNION ALL SELECT row_id, 'line', CAST(line AS DOUBLE), 1.0, 7.0 FROM obs)
         WHERE v IS NOT NULL AND (v < low OR v > high)""",
    "univariate_auc": L
    + """, g AS (SELECT attr, v, sum(y) AS npos, sum(1 - y) AS nneg FROM
               (SELECT attr, v, CASE WHEN failure = 'yes' THEN 1 ELSE 0 END AS y FROM lng WHERE v IS NOT NULL) GROUP BY attr, v),
         c AS (SELECT *, coalesce(sum(nneg) OVER (PARTITION BY attr ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM g),
         r AS (SELECT attr, sum(npos * (nb + nneg / 2.0)) AS u, CAST(sum(npos) AS DOUBLE) AS n1, CAST(sum(nneg) AS DOUBLE) AS n2,
                      sum(CAST(npos + nneg AS DOUBLE) ^ 3 - (npos + nneg)) AS tie FROM c GROUP BY attr),
         m AS (SELECT attr, avg(v) FILTER (WHERE failure = 'yes') AS mean_pos, avg(v) FILTER (WHERE failure = 'no') AS mean_neg
               FROM lng WHERE v IS NOT NULL GROUP BY attr)
    SELECT r.attr, CAST(n1 AS BIGINT) AS n_pos, CAST(n2 AS BIGINT) AS n_neg, round(mean_pos, 6) AS mean_pos, round(mean_neg, 6) AS mean_neg,
           round(u / (n1 * n2), 6) AS auc, round(u, 6) AS u,
           round((abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - tie / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z,
           CASE WHEN u / (n1 * n2) >= 0.5 THEN 'direct' ELSE 'inverse' END AS direction,
           CAST(row_number() OVER (ORDER BY abs(u / (n1 * n2) - 0.5) DESC NULLS LAST, r.attr) AS INTEGER) AS rank
    FROM r JOIN m ON r.attr = m.attr""",
    "class_balance": BASE
    + """, cc AS (SELECT coalesce(failure, 'nan') AS class, count(*) AS n_class FROM valid GROUP BY 1)
    SELECT CAST(sum(n_class) AS BIGINT) AS n, count(*) AS n_classes, (SELECT count(*) FILTER (WHERE failure IS NULL) FROM valid) AS nulls_in_target,
           CAST(coalesce(sum(n_class) FILTER (WHERE class = 'yes'), 0) AS BIGINT) AS n_positive,
           round(coalesce(sum(n_class) FILTER (WHERE class = 'yes'), 0) / sum(n_class), 6) AS prevalence,
           (SELECT min(class) FROM cc WHERE n_class = (SELECT max(n_class) FROM cc)) AS majority_class,
           round(max(n_class) / sum(n_class), 6) AS majority_accuracy
    FROM cc""",
    "class_counts": BASE + "SELECT coalesce(failure, 'nan') AS class, count(*) AS n_class FROM valid GROUP BY 1",
    "correlation_matrix": BASE
    + f"""SELECT a, b, round(r, 6) AS r FROM (
            SELECT a, b, r FROM ({CORR_SQL})
            UNION ALL SELECT b, a, r FROM ({CORR_SQL})
            UNION ALL SELECT a, a, 1.0 FROM (VALUES {", ".join(f"('{a}')" for a in ATTRS)}) t(a))""",
    "max_abs_corr": BASE
    + f""", p AS (SELECT * FROM ({" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {i} AS o, corr({a}, {b}) AS r FROM valid" for i, (a, b) in enumerate(CORR_PAIRS))}) WHERE r IS NOT NULL AND NOT isnan(r))
    SELECT a AS attr_a, b AS attr_b, round(r, 6) AS r, round(abs(r), 6) AS max_abs_r FROM p ORDER BY abs(r) DESC, o LIMIT 1""",
    "class_histogram": L
    + """, x AS (SELECT attr, failure AS class, v FROM lng WHERE v IS NOT NULL AND failure IS NOT NULL),
         rg AS (SELECT attr, min(v) AS mn, max(v) AS mx FROM x GROUP BY attr),
         nc AS (SELECT attr, class, count(*) AS n_class FROM x GROUP BY attr, class),
         h AS (SELECT x.attr, class, CAST(CASE WHEN mx = mn THEN 0 ELSE least(floor((v - mn) / ((mx - mn) / 18)), 17) END AS INTEGER) AS bin
               FROM x JOIN rg ON x.attr = rg.attr)
    SELECT h.attr, h.class, bin, count(*) AS count, round(count(*) / any_value(n_class), 6) AS weight
    FROM h JOIN nc ON h.attr = nc.attr AND h.class = nc.class GROUP BY h.attr, h.class, bin""",
    "class_boxplot": L
    + """, x AS (SELECT attr, failure AS class, v FROM lng WHERE v IS NOT NULL AND failure IS NOT NULL),
         q AS (SELECT attr, class, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM x GROUP BY attr, class)
    SELECT q.attr, q.class, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
           round(min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_lo,
           round(max(v) FILTER (WHERE v <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_hi,
           count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS n_outliers
    FROM x JOIN q ON x.attr = q.attr AND x.class = q.class GROUP BY q.attr, q.class, q1, median, q3""",
    "table_shape": BASE + "SELECT count(*) AS n_rows, 6 AS n_columns, count(DISTINCT failure) AS n_labels, count(DISTINCT failure) = 2 AS two_classes FROM valid",
}
