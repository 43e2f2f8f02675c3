"""CSV scan with contract on dirty text: bad cells, permuted headers, short and long rows."""

import pytest

from rarefold.operators import contract
from rarefold.sources import io
from rarefold.spec import LAB180, ContractError

HEAD = "temperature_c,vibration_mm_s,pressure_bar,hours_since_maintenance,load_percent,failure"


def scan(spark, tmp_path, text):
    path = tmp_path / "in.csv"
    path.write_text(text)
    return io.scan_csv(spark, str(path), LAB180, key=None)


def test_bad_cell_is_quarantined_not_nulled(spark, tmp_path):
    typed, types = scan(spark, tmp_path, f"{HEAD}\n70,4,6,100,50,no\nabc,4,6,100,50,no\n,4,6,100,50,yes\n")
    assert [(r.row_id, r.column, r.value) for r in types.collect()] == [("1", "temperature_c", "abc")]
    valid, bad = contract.split(typed, LAB180)
    assert sorted(r.row_id for r in valid.collect()) == ["0", "2"]
    assert [(r.row_id, r.quarantine_reason) for r in bad.collect()] == [("1", "temperature_c='abc' incumple dtype('double')")]


def test_columns_go_by_header_name(spark, tmp_path):
    typed, _ = scan(spark, tmp_path, "vibration_mm_s,temperature_c,pressure_bar,hours_since_maintenance,load_percent,failure\n4,70,6,100,50,no\n")
    r = typed.first()
    assert (r.temperature_c, r.vibration_mm_s) == (70.0, 4.0)


def test_short_and_long_rows_are_quarantined(spark, tmp_path):
    typed, _ = scan(spark, tmp_path, f"{HEAD}\n70,4,6,100,50,no\n70,4\n70,4,6,100,50,no,9,9\n")
    valid, bad = contract.split(typed, LAB180)
    assert valid.count() == 1
    assert all("row incumple cells(6)" in r.quarantine_reason for r in bad.collect()) and bad.count() == 2


def test_missing_column_raises(spark, tmp_path):
    with pytest.raises(ContractError):
        scan(spark, tmp_path, "temperature_c,failure\n70,no\n")


def test_column_without_any_good_cell_raises(spark, tmp_path):
    with pytest.raises(ContractError):
        scan(spark, tmp_path, f"{HEAD}\na,4,6,100,50,no\nb,4,6,100,50,no\n")


def test_replayed_sink_run_does_not_double(spark, tmp_path):
    bad = spark.createDataFrame([("1", "x"), ("2", "y")], "row_id string, quarantine_reason string")
    root = str(tmp_path / "q")
    assert io.quarantine_sink(bad, "lab", root, "run1") == 2 and io.quarantine_sink(bad, "lab", root, "run1") == 2
    assert io.quarantine_sink(bad, "lab", root, "run2") == 2
    assert io.read_quarantine(spark, root, "lab").count() == 4
    assert io.quarantine_sink(bad.limit(0), "lab", str(tmp_path / "none")) == 0


def test_only_an_absent_report_reads_as_empty(spark, tmp_path):
    assert io.read_report(spark, str(tmp_path / "absent")).count() == 0


def test_flag_target_counts_its_ones(spark):
    from rarefold.spec import AI4I2020

    assert contract.positive_value(AI4I2020) == "1" and contract.positive_value(LAB180) == "yes"
