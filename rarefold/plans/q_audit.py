"""Registered queries, sections D (audit) and E (features)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rarefold.operators import audit, features
from rarefold.plans.common import obs, rounded, valid
from rarefold.plans.oracle_base import BASE, LONG, OBS, TAGGED, VALID, with_
from rarefold.plans.q_contract import MILL
from rarefold.plans.q_profile import ATTRS, CORR_PAIRS
from rarefold.spec import AI4I2020
from rarefold.spec import OBS as SPEC

INTS = {"line"}


def q_audit_correlation(spark, sf):
    return rounded(audit.audit_correlation(valid(spark, sf), ATTRS))


def q_audit_missingness(spark, sf):
    return audit.audit_missingness(valid(spark, sf), ATTRS)


def q_audit_hypergeom(spark, sf):
    return rounded(audit.audit_hypergeom(valid(spark, sf), ATTRS, "failure", "yes"))


def q_decimal_resolution(spark, sf):
    return audit.decimal_resolution(valid(spark, sf), ATTRS, INTS)


def q_last_digit_counts(spark, sf):
    return audit.last_digit_counts(valid(spark, sf), ATTRS, INTS)


def q_digit_chi2(spark, sf):
    return rounded(audit.digit_chi2(valid(spark, sf), ATTRS, INTS))


def q_digit_uniformity(spark, sf):
    return rounded(audit.digit_uniformity(valid(spark, sf), ATTRS, INTS))


def q_plausibility_verdict(spark, sf):
    return audit.plausibility_verdict(valid(spark, sf), ATTRS, INTS)


def _mill(spark, sf):
    return features.milling_view(obs(spark, sf, extra=True))


def q_engineer_power(spark, sf):
    e = features.engineer_milling(_mill(spark, sf))
    return rounded(e.select("row_id", "power_w", "temp_delta_k", "wear_x_torque"))


def q_engineer_onehot(spark, sf):
    e = features.engineer_milling(_mill(spark, sf))
    return e.groupBy("type", "type_L", "type_M", "type_H").agg(F.count(F.lit(1)).alias("n"))


def q_label_remap(spark, sf):
    e = features.label_remap(_mill(spark, sf), "machine_failure")
    return e.groupBy("machine_failure").agg(F.count(F.lit(1)).alias("n"))


def q_feature_matrix(spark, sf):
    e = features.engineer_milling(_mill(spark, sf))
    return rounded(features.feature_matrix(e, AI4I2020))


def q_mode_consistency(spark, sf):
    m = _mill(spark, sf)
    return features.mode_consistency(m, F.col("machine_failure"))


def q_feature_by_mode(spark, sf):
    e = features.engineer_milling(_mill(spark, sf))
    return rounded(features.feature_by_mode(e, "power_w"))


def q_ingest_rename_project(spark, sf):
    m = _mill(spark, sf)
    raw_names = {v: k for k, v in features.RENAME_MAP.items()}
    feats = m.select("row_id", *[F.col(c).alias(raw_names[c]) for c in features.CANONICAL[:6]])
    targets = m.select("row_id", *[F.col(c).alias(raw_names[c]) for c in features.CANONICAL[6:]])
    return rounded(features.ingest_rename_project(feats, targets))


QUERIES = {
    "audit_correlation": q_audit_correlation,
    "audit_missingness": q_audit_missingness,
    "audit_hypergeom": q_audit_hypergeom,
    "decimal_resolution": q_decimal_resolution,
    "last_digit_counts": q_last_digit_counts,
    "digit_chi2": q_digit_chi2,
    "digit_uniformity": q_digit_uniformity,
    "plausibility_verdict": q_plausibility_verdict,
    "engineer_power": q_engineer_power,
    "engineer_onehot": q_engineer_onehot,
    "label_remap": q_label_remap,
    "feature_matrix": q_feature_matrix,
    "mode_consistency": q_mode_consistency,
    "feature_by_mode": q_feature_by_mode,
    "ingest_rename_project": q_ingest_rename_project,
}

_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {i} AS o, corr({a}, {b}) AS r FROM valid" for i, (a, b) in enumerate(CORR_PAIRS)
)
MAXR = f"mr AS (SELECT a AS attr_a, b AS attr_b, r, abs(r) AS max_abs_r FROM ({_PAIRS}) WHERE r IS NOT NULL AND NOT isnan(r) ORDER BY abs(r) DESC, o LIMIT 1)"
NROW = "(SELECT CAST(qty IS NULL AS INT) + CAST(price IS NULL AS INT) + CAST(disc IS NULL AS INT) + CAST(tax IS NULL AS INT) + CAST(line IS NULL AS INT) AS k, failure FROM valid)"
MISS = f"""miss AS (
  SELECT count(*) FILTER (WHERE nulls > 0) AS affected_columns,
         (SELECT CAST(coalesce(sum(k), 0) AS BIGINT) FROM {NROW}) AS total_nulls,
         (SELECT coalesce(max(k), 0) FROM {NROW}) AS max_in_row,
         count(*) FILTER (WHERE nulls > 0) > 0 AND count(DISTINCT nulls) FILTER (WHERE nulls > 0) = 1 AS equal_per_column,
         (SELECT coalesce(max(k), 0) <= 1 FROM {NROW}) AS no_overlap
  FROM (SELECT attr, count(*) FILTER (WHERE v IS NULL) AS nulls FROM lng GROUP BY attr))"""
DEC = """dec AS (
  SELECT attr, CASE WHEN attr = 'line' THEN 0
                    WHEN bool_and(abs(round_even(v, 0) - v) <= 1e-9 + 1e-5 * abs(v)) THEN 0
                    WHEN bool_and(abs(round_even(v, 1) - v) <= 1e-9 + 1e-5 * abs(v)) THEN 1
                    WHEN bool_and(abs(round_even(v, 2) - v) <= 1e-9 + 1e-5 * abs(v)) THEN 2
                    WHEN bool_and(abs(round_even(v, 3) - v) <= 1e-9 + 1e-5 * abs(v)) THEN 3
                    ELSE 4 END AS decimals
  FROM lng WHERE v IS NOT NULL GROUP BY attr)"""
DIG = """dig AS (
  SELECT g.attr, g.digit, coalesce(c.count, 0) AS count FROM
    (SELECT attr, CAST(d AS INTEGER) AS digit FROM (SELECT DISTINCT attr FROM lng), range(10) t(d)) g
    LEFT JOIN (SELECT lng.attr, CAST(((CAST(round_even(v * power(10.0, decimals), 0) AS BIGINT) % 10) + 10) % 10 AS INTEGER) AS digit, count(*) AS count
               FROM lng JOIN dec ON lng.attr = dec.attr WHERE v IS NOT NULL GROUP BY 1, 2) c
    ON g.attr = c.attr AND g.digit = c.digit)"""
# 16.918977604620448: the value that chi-square with 9 degrees of freedom exceeds with probability 0.05
UNIFORM = """uni AS (
  SELECT coalesce(bool_and(chi2 < 16.918977604620448), false) AS digits_uniform FROM (
    SELECT d.attr, sum(CASE WHEN n > 0 THEN (count - n / 10.0) ^ 2 / (n / 10.0) END) AS chi2
    FROM dig d JOIN (SELECT attr, sum(count) AS n FROM dig GROUP BY attr) t ON d.attr = t.attr GROUP BY d.attr))"""
DL = with_(OBS, TAGGED, VALID, LONG)

ORACLE = {
    "audit_correlation": with_(OBS, TAGGED, VALID, MAXR)
    + """SELECT attr_a, attr_b, round(r, 6) AS r, round(max_abs_r, 6) AS max_abs_r, CAST(0.15 AS DOUBLE) AS threshold,
                coalesce(max_abs_r < 0.15, false) AS independent,
                printf('max |r| = %.4f between %s and %s (%s threshold %.2f)', max_abs_r, attr_a, attr_b,
                       CASE WHEN coalesce(max_abs_r < 0.15, false) THEN 'below' ELSE 'above' END, 0.15) AS evidence
         FROM mr""",
    "audit_missingness": with_(OBS, TAGGED, VALID, LONG, MISS)
    + "SELECT affected_columns, total_nulls, max_in_row, equal_per_column, no_overlap, equal_per_column AND no_overlap AS suspicious_regularity FROM miss",
    "decimal_resolution": with_(OBS, TAGGED, VALID, LONG, DEC) + "SELECT attr, decimals FROM dec",
    "last_digit_counts": with_(OBS, TAGGED, VALID, LONG, DEC, DIG) + "SELECT attr, digit, count FROM dig",
    "digit_chi2": with_(OBS, TAGGED, VALID, LONG, DEC, DIG)
    + """SELECT d.attr, n, round(sum(CASE WHEN n > 0 THEN (count - n / 10.0) ^ 2 / (n / 10.0) END), 6) AS chi2, any_value(decimals) AS decimals
         FROM dig d JOIN (SELECT attr, sum(count) AS n FROM dig GROUP BY attr) t ON d.attr = t.attr JOIN dec ON d.attr = dec.attr
         GROUP BY d.attr, n""",
    "plausibility_verdict": with_(OBS, TAGGED, VALID, LONG, MAXR, MISS, DEC, DIG, UNIFORM)
    + """SELECT coalesce(max_abs_r < 0.15, false) AS independent, equal_per_column AND no_overlap AS suspicious_regularity, digits_uniform,
                coalesce(max_abs_r < 0.15, false) AND equal_per_column AND no_overlap AS probably_synthetic,
                CASE WHEN coalesce(max_abs_r < 0.15, false) AND equal_per_column AND no_overlap THEN 'probably synthetic' ELSE 'compatible with real data' END AS verdict,
                printf('max |r| = %.4f between %s and %s (%s threshold %.2f)', max_abs_r, attr_a, attr_b,
                       CASE WHEN coalesce(max_abs_r < 0.15, false) THEN 'below' ELSE 'above' END, 0.15) || ' | ' || printf('%d nulls', total_nulls)
                || CASE WHEN digits_uniform THEN ' | last decimal digits are compatible with uniform sampling in every attribute (weak, supporting evidence)' ELSE '' END AS evidence
         FROM mr, miss, uni""",
    "engineer_power": with_(OBS, MILL)
    + """SELECT row_id, round(torque_nm * rotational_speed_rpm * (2 * pi()) / 60.0, 6) AS power_w,
                round(process_temperature_k - air_temperature_k, 6) AS temp_delta_k, round(tool_wear_min * torque_nm, 6) AS wear_x_torque FROM mill""",
    "engineer_onehot": with_(OBS, MILL)
    + """SELECT type, CAST(type = 'L' AS INTEGER) AS type_L, CAST(type = 'M' AS INTEGER) AS type_M, CAST(type = 'H' AS INTEGER) AS type_H,
                count(*) AS n FROM mill GROUP BY ALL""",
    "label_remap": with_(OBS, MILL)
    + "SELECT CASE WHEN machine_failure = 1 THEN 'yes' WHEN machine_failure = 0 THEN 'no' END AS machine_failure, count(*) AS n FROM mill GROUP BY 1",
    "feature_matrix": with_(OBS, MILL)
    + """SELECT row_id, round(air_temperature_k, 6) AS air_temperature_k, round(process_temperature_k, 6) AS process_temperature_k,
                CAST(rotational_speed_rpm AS DOUBLE) AS rotational_speed_rpm, round(torque_nm, 6) AS torque_nm, CAST(tool_wear_min AS DOUBLE) AS tool_wear_min,
                round(torque_nm * rotational_speed_rpm * (2 * pi()) / 60.0, 6) AS power_w,
                round(process_temperature_k - air_temperature_k, 6) AS temp_delta_k, round(tool_wear_min * torque_nm, 6) AS wear_x_torque,
                CAST(type = 'L' AS DOUBLE) AS type_L, CAST(type = 'M' AS DOUBLE) AS type_M, CAST(type = 'H' AS DOUBLE) AS type_H,
                CAST(machine_failure = 1 AS INTEGER) AS label FROM mill""",
    "mode_consistency": with_(OBS, MILL)
    + """SELECT CAST(sum(twf) AS BIGINT) AS n_twf, CAST(sum(hdf) AS BIGINT) AS n_hdf, CAST(sum(pwf) AS BIGINT) AS n_pwf,
                CAST(sum(osf) AS BIGINT) AS n_osf, CAST(sum(rnf) AS BIGINT) AS n_rnf,
                count(*) FILTER (WHERE twf + hdf + pwf + osf + rnf >= 1) AS rows_ge1_mode,
                count(*) FILTER (WHERE twf + hdf + pwf + osf + rnf >= 2) AS rows_ge2_modes,
                count(*) FILTER (WHERE twf + hdf + pwf + osf + rnf >= 1 AND machine_failure = 0) AS mode_without_label,
                count(*) FILTER (WHERE twf + hdf + pwf + osf + rnf = 0 AND machine_failure = 1) AS label_without_mode FROM mill""",
    "feature_by_mode": with_(OBS, MILL)
    + """, e AS (SELECT torque_nm * rotational_speed_rpm * (2 * pi()) / 60.0 AS v, twf, hdf, pwf, osf, rnf FROM mill),
         l AS (SELECT 'twf' AS mode, CAST(twf AS INTEGER) AS flag, v FROM e UNION ALL SELECT 'hdf', CAST(hdf AS INTEGER), v FROM e
               UNION ALL SELECT 'pwf', CAST(pwf AS INTEGER), v FROM e UNION ALL SELECT 'osf', CAST(osf AS INTEGER), v FROM e
               UNION ALL SELECT 'rnf', CAST(rnf AS INTEGER), v FROM e)
    SELECT mode, flag, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(min(v), 6) AS min, round(max(v), 6) AS max
    FROM l GROUP BY mode, flag""",
    "ingest_rename_project": with_(OBS, MILL)
    + """SELECT row_id, type, round(air_temperature_k, 6) AS air_temperature_k, round(process_temperature_k, 6) AS process_temperature_k,
                rotational_speed_rpm, round(torque_nm, 6) AS torque_nm, tool_wear_min, machine_failure, twf, hdf, pwf, osf, rnf FROM mill""",
}
