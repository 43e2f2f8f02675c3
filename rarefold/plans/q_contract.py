"""Registered queries, section B (contract) and A (scan / ingest)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rarefold.operators import contract, features
from rarefold.plans.common import obs, rounded, tagged, valid
from rarefold.plans.oracle_base import BASE, OBS, TAGGED, VALID, with_
from rarefold.spec import AI4I2020, OBS as SPEC


def q_contract_reasons(spark, sf):
    t = tagged(spark, sf)
    return t.filter(F.col("quarantine_reason").isNotNull()).select("row_id", "quarantine_reason")


def q_contract_split(spark, sf):
    _, bad = contract.split(obs(spark, sf), SPEC)
    return rounded(bad.select("row_id", "qty", "price", "disc", "tax", "line", "failure", "quarantine_reason"))


def q_contract_valid(spark, sf):
    v = valid(spark, sf)
    return rounded(v.select("row_id", "qty", "price", "disc", "tax", "line", "failure"))


def q_contract_summary(spark, sf):
    return contract.contract_summary(tagged(spark, sf))


def q_reason_counts(spark, sf):
    return contract.reason_counts(tagged(spark, sf))


def q_range_violations(spark, sf):
    return contract.violations_long(obs(spark, sf), SPEC, kinds=("range",))


def q_isin_violations(spark, sf):
    m = features.milling_view(obs(spark, sf, extra=True))
    return contract.violations_long(m, AI4I2020, kinds=("isin",))


def q_notnull_violations(spark, sf):
    return contract.violations_long(obs(spark, sf), SPEC, kinds=("not_nullable",))


def q_milling_contract_summary(spark, sf):
    m = features.milling_view(obs(spark, sf, extra=True))
    contract.check_structure(m, AI4I2020, allow=("row_id",))
    return contract.contract_summary(contract.tag(m, AI4I2020))


def q_warn_prevalence(spark, sf):
    return rounded(contract.warn_prevalence(valid(spark, sf), SPEC))


def q_warn_null_rate(spark, sf):
    return rounded(contract.warn_null_rate(valid(spark, sf), SPEC))


def q_full_duplicates(spark, sf):
    return contract.full_duplicates(valid(spark, sf), ["qty", "price", "disc", "tax", "line", "failure"])


QUERIES = {
    "contract_reasons": q_contract_reasons,
    "contract_split": q_contract_split,
    "contract_valid": q_contract_valid,
    "contract_summary": q_contract_summary,
    "reason_counts": q_reason_counts,
    "range_violations": q_range_violations,
    "isin_violations": q_isin_violations,
    "notnull_violations": q_notnull_violations,
    "milling_contract_summary": q_milling_contract_summary,
    "warn_prevalence": q_warn_prevalence,
    "warn_null_rate": q_warn_null_rate,
    "full_duplicates": q_full_duplicates,
}

MILL = """mill AS (
  SELECT row_id,
         CASE returnflag WHEN 'A' THEN 'L' WHEN 'N' THEN 'M' ELSE 'H' END AS type,
         295.0 + 100.0 * tax AS air_temperature_k,
         305.0 + 100.0 * disc AS process_temperature_k,
         CAST(floor(extprice / 10.0) AS BIGINT) AS rotational_speed_rpm,
         qty AS torque_nm,
         CAST(suppkey % 250 AS BIGINT) AS tool_wear_min,
         CAST(CASE WHEN failure = 'yes' THEN 1 ELSE 0 END AS BIGINT) AS machine_failure,
         CAST(CASE WHEN qty >= 41 THEN 1 ELSE 0 END AS BIGINT) AS twf,
         CAST(CASE WHEN disc >= 0.05 THEN 1 ELSE 0 END AS BIGINT) AS hdf,
         CAST(CASE WHEN returnflag = 'R' THEN 1 ELSE 0 END AS BIGINT) AS pwf,
         CAST(CASE WHEN line = 7 THEN 1 ELSE 0 END AS BIGINT) AS osf,
         CAST(CASE WHEN linestatus = 'F' AND line = 1 AND qty <= 2 THEN 1 ELSE 0 END AS BIGINT) AS rnf
  FROM obs)"""

ORACLE = {
    "contract_reasons": BASE + "SELECT row_id, quarantine_reason FROM tagged WHERE quarantine_reason IS NOT NULL",
    "contract_split": BASE
    + """SELECT row_id, qty, round(price, 6) AS price, disc, tax, line, failure, quarantine_reason
         FROM tagged WHERE quarantine_reason IS NOT NULL""",
    "contract_valid": BASE + "SELECT row_id, qty, round(price, 6) AS price, disc, tax, line, failure FROM valid",
    "contract_summary": BASE
    + """SELECT count(*) AS n_read, count(*) FILTER (WHERE quarantine_reason IS NULL) AS n_valid,
                count(*) FILTER (WHERE quarantine_reason IS NOT NULL) AS n_quarantined FROM tagged""",
    "reason_counts": BASE + "SELECT quarantine_reason, count(*) AS n FROM tagged WHERE quarantine_reason IS NOT NULL GROUP BY 1",
    "range_violations": with_(OBS)
    + """SELECT row_id, 'qty' AS column, 'less_than_or_equal_to(49.0)' AS "check", CAST(qty AS VARCHAR) AS value FROM obs WHERE qty > 49
         UNION ALL SELECT row_id, 'qty', 'greater_than_or_equal_to(0.0)', CAST(qty AS VARCHAR) FROM obs WHERE qty < 0
         UNION ALL SELECT row_id, 'price', 'greater_than_or_equal_to(0.0)', CAST(price AS VARCHAR) FROM obs WHERE price < 0
         UNION ALL SELECT row_id, 'disc', 'greater_than_or_equal_to(0.0)', CAST(disc AS VARCHAR) FROM obs WHERE disc < 0
         UNION ALL SELECT row_id, 'disc', 'less_than_or_equal_to(1.0)', CAST(disc AS VARCHAR) FROM obs WHERE disc > 1
         UNION ALL SELECT row_id, 'tax', 'greater_than_or_equal_to(0.0)', CAST(tax AS VARCHAR) FROM obs WHERE tax < 0
         UNION ALL SELECT row_id, 'tax', 'less_than_or_equal_to(1.0)', CAST(tax AS VARCHAR) FROM obs WHERE tax > 1
         UNION ALL SELECT row_id, 'line', 'greater_than_or_equal_to(1.0)', CAST(line AS VARCHAR) FROM obs WHERE line < 1
         UNION ALL SELECT row_id, 'line', 'less_than_or_equal_to(7.0)', CAST(line AS VARCHAR) FROM obs WHERE line > 7""",
    "isin_violations": with_(OBS, MILL)
    + """SELECT row_id, 'type' AS column, 'isin([''L'', ''M'', ''H''])' AS "check", type AS value FROM mill WHERE type NOT IN ('L', 'M', 'H')
         UNION ALL SELECT row_id, 'machine_failure', 'isin([0, 1])', CAST(machine_failure AS VARCHAR) FROM mill WHERE machine_failure NOT IN (0, 1)
         UNION ALL SELECT row_id, 'twf', 'isin([0, 1])', CAST(twf AS VARCHAR) FROM mill WHERE twf NOT IN (0, 1)
         UNION ALL SELECT row_id, 'hdf', 'isin([0, 1])', CAST(hdf AS VARCHAR) FROM mill WHERE hdf NOT IN (0, 1)
         UNION ALL SELECT row_id, 'pwf', 'isin([0, 1])', CAST(pwf AS VARCHAR) FROM mill WHERE pwf NOT IN (0, 1)
         UNION ALL SELECT row_id, 'osf', 'isin([0, 1])', CAST(osf AS VARCHAR) FROM mill WHERE osf NOT IN (0, 1)
         UNION ALL SELECT row_id, 'rnf', 'isin([0, 1])', CAST(rnf AS VARCHAR) FROM mill WHERE rnf NOT IN (0, 1)""",
    "notnull_violations": with_(OBS)
    + """SELECT row_id, 'qty' AS column, 'not_nullable' AS "check", CAST(NULL AS VARCHAR) AS value FROM obs WHERE qty IS NULL
         UNION ALL SELECT row_id, 'disc', 'not_nullable', NULL FROM obs WHERE disc IS NULL
         UNION ALL SELECT row_id, 'tax', 'not_nullable', NULL FROM obs WHERE tax IS NULL
         UNION ALL SELECT row_id, 'line', 'not_nullable', NULL FROM obs WHERE line IS NULL
         UNION ALL SELECT row_id, 'failure', 'not_nullable', NULL FROM obs WHERE failure IS NULL""",
    "milling_contract_summary": with_(OBS, MILL)
    + """SELECT count(*) AS n_read,
                count(*) FILTER (WHERE air_temperature_k BETWEEN 280 AND 320 AND process_temperature_k BETWEEN 280 AND 320
                                 AND rotational_speed_rpm > 0 AND torque_nm >= 0 AND tool_wear_min >= 0) AS n_valid,
                count(*) FILTER (WHERE NOT (air_temperature_k BETWEEN 280 AND 320 AND process_temperature_k BETWEEN 280 AND 320
                                 AND rotational_speed_rpm > 0 AND torque_nm >= 0 AND tool_wear_min >= 0)) AS n_quarantined
         FROM mill""",
    "warn_prevalence": BASE
    + """SELECT n, n_positive, round(n_positive / n, 6) AS prevalence,
                NOT (n_positive / n BETWEEN 0.01 AND 0.5) AS warn
         FROM (SELECT count(*) AS n, count(*) FILTER (WHERE failure = 'yes') AS n_positive FROM valid)""",
    "warn_null_rate": BASE
    + """SELECT attr, nulls, n, round(nulls / n, 6) AS null_rate, nulls / n > 0.1 AS warn FROM (
           SELECT 'qty' AS attr, count(*) FILTER (WHERE qty IS NULL) AS nulls, count(*) AS n FROM valid
           UNION ALL SELECT 'price', count(*) FILTER (WHERE price IS NULL), count(*) FROM valid
           UNION ALL SELECT 'disc', count(*) FILTER (WHERE disc IS NULL), count(*) FROM valid
           UNION ALL SELECT 'tax', count(*) FILTER (WHERE tax IS NULL), count(*) FROM valid
           UNION ALL SELECT 'line', count(*) FILTER (WHERE line IS NULL), count(*) FROM valid)""",
    "full_duplicates": BASE
    + """SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS n_duplicates FROM (
           SELECT count(*) AS c FROM valid GROUP BY qty, price, disc, tax, line, failure)""",
}
