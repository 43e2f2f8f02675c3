"""Property: any frame whose values lie inside the physical ranges passes the contract."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rarefold.operators import contract
from rarefold.spec import LAB180, QuarantineNotEmpty

row = st.tuples(
    st.one_of(st.none(), st.floats(-273.15, 300.0)),
    st.one_of(st.none(), st.floats(0.0, 100.0)),
    st.one_of(st.none(), st.floats(0.0, 1000.0)),
    st.integers(0, 100000),
    st.floats(0.0, 100.0),
    st.sampled_from(["yes", "no"]),
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, min_size=1, max_size=20))
def test_in_range_frames_always_pass(spark, rows):
    schema = "temperature_c double, vibration_mm_s double, pressure_bar double, hours_since_maintenance bigint, load_percent double, failure string"
    df = spark.createDataFrame(rows, schema)
    contract.check_structure(df, LAB180)
    valid, bad = contract.split(df, LAB180)
    assert bad.count() == 0 and valid.count() == len(rows)


def test_quality_gate(spark):
    schema = "temperature_c double, vibration_mm_s double, pressure_bar double, hours_since_maintenance bigint, load_percent double, failure string"
    good = spark.createDataFrame([(70.0, 4.0, 6.0, 100, 50.0, "no")], schema)
    bad = spark.createDataFrame([(70.0, -1.0, 6.0, 100, 50.0, "no")], schema)
    assert contract.quality_gate(contract.tag(good, LAB180)) == 0
    with pytest.raises(QuarantineNotEmpty):
        contract.quality_gate(contract.tag(bad, LAB180))
    assert contract.quality_gate(contract.tag(bad, LAB180), enforce=False) == 1
