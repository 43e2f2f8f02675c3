"""Goldens of the lab table: contract, profile, audit (values published with the reference)."""

import pytest
from pyspark.sql import functions as F

from rarefold.operators import audit, contract, profile
from rarefold.spec import LAB180, ContractError


def test_contract_quarantines_row_82(lab):
    typed, types = lab
    assert types.count() == 0
    valid, bad = contract.split(typed, LAB180)
    assert valid.count() == 179
    rows = bad.collect()
    assert len(rows) == 1
    assert rows[0]["row_id"] == "82"
    assert rows[0]["quarantine_reason"] == "vibration_mm_s=-0.34 incumple greater_than_or_equal_to(0.0)"
    s = contract.contract_summary(contract.tag(typed, LAB180)).first()
    assert (s.n_read, s.n_valid, s.n_quarantined) == (180, 179, 1)


def test_structural_failure_raises(spark):
    df = spark.createDataFrame([(70.0,)], "temperature_c double")
    with pytest.raises(ContractError):
        contract.check_structure(df, LAB180)


def test_wrong_type_is_structural(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0, 1, 1.0, "no")], "temperature_c string, vibration_mm_s double, pressure_bar double, hours_since_maintenance bigint, load_percent double, failure string")
    with pytest.raises(ContractError):
        contract.check_structure(df, LAB180)


def test_label_outside_domain_is_a_row_violation(spark):
    df = spark.createDataFrame([("0", 70.0, 4.0, 6.0, 100, 50.0, "tal_vez")], "row_id string, temperature_c double, vibration_mm_s double, pressure_bar double, hours_since_maintenance bigint, load_percent double, failure string")
    _, bad = contract.split(df, LAB180)
    assert bad.first()["quarantine_reason"] == "failure='tal_vez' incumple isin(['yes', 'no'])"


def test_descriptive_table_goldens(lab):
    typed, _ = lab
    t = {r["attr"]: r for r in profile.descriptive_table(typed, LAB180.numeric_attributes()).collect()}
    temp = t["temperature_c"]
    assert (temp.n, temp.nulls) == (176, 4)
    assert temp["min"] == pytest.approx(47.0) and temp["max"] == pytest.approx(89.8)
    assert temp["mean"] == pytest.approx(67.8102, abs=1e-3)
    assert temp["median"] == pytest.approx(67.95, abs=1e-3)
    assert temp["sd"] == pytest.approx(7.6651, abs=1e-3)
    h = t["hours_since_maintenance"]
    assert (h.n, h.nulls, h["median"]) == (180, 0, 440.0)
    assert h["mean"] == pytest.approx(473.1889, abs=1e-3) and h["sd"] == pytest.approx(262.3427, abs=1e-3)
    assert t["vibration_mm_s"]["min"] == pytest.approx(-0.34)


def test_class_balance(lab):
    typed, _ = lab
    b = profile.class_balance(typed, "failure", "yes").first()
    assert (b.n, b.n_positive, b.majority_class) == (180, 10, "no")
    assert b.majority_accuracy == pytest.approx(170 / 180)


def test_univariate_auc_and_p(lab):
    typed, _ = lab
    r = {x["attr"]: x for x in profile.univariate_auc(typed, LAB180).collect()}
    expected = {
        "vibration_mm_s": (0.8503, 0.00020), "temperature_c": (0.7259, 0.01669),
        "hours_since_maintenance": (0.7218, 0.01871), "load_percent": (0.6682, 0.07459),
        "pressure_bar": (0.2515, 0.00846),
    }
    for attr, (auc, p) in expected.items():
        assert r[attr]["auc"] == pytest.approx(auc, abs=1e-3)
        assert r[attr]["p_value"] == pytest.approx(p, rel=0.02, abs=1e-5)
    assert r["pressure_bar"]["direction"] == "inverse"


def test_physical_anomaly_row_82(lab):
    typed, _ = lab
    rows = profile.physical_anomalies(typed, LAB180.ranges()).collect()
    assert [(r.row_id, r.attr, r.violation) for r in rows] == [("82", "vibration_mm_s", "below minimum")]


def test_max_abs_correlation(lab):
    typed, _ = lab
    m = profile.max_abs_corr(typed, LAB180.numeric_attributes()).first()
    assert m.max_abs_r == pytest.approx(0.097, abs=1e-3)
    assert {m.attr_a, m.attr_b} == {"load_percent", "vibration_mm_s"}


def test_missingness_and_hypergeometric(lab):
    typed, _ = lab
    attrs = LAB180.numeric_attributes()
    h = audit.audit_hypergeom(typed, attrs, "failure", "yes").first()
    assert h.p_value == pytest.approx(0.4924, abs=1e-4)
    m = audit.audit_missingness(typed, attrs).first()
    assert m.equal_per_column and m.no_overlap


def test_decimal_resolution(lab):
    typed, _ = lab
    d = {r.attr: r.decimals for r in audit.decimal_resolution(typed, LAB180.numeric_attributes(), {"hours_since_maintenance"}).collect()}
    assert d["temperature_c"] == 1 and d["vibration_mm_s"] == 2


def test_last_digit_keeps_zero_counts(lab):
    typed, _ = lab
    c = audit.last_digit_counts(typed, LAB180.numeric_attributes(), {"hours_since_maintenance"})
    assert c.groupBy("attr").count().filter(F.col("count") != 10).count() == 0
