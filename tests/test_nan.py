"""NaN reads as null in every profile operator: a frame with NaN gives what the same frame with nulls gives."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rarefold.operators import profile
from rarefold.spec import OBS

ATTRS = OBS.numeric_attributes()


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(6)
    rows = [(f"r{i}", *[math.nan if a == "price" and i % 10 == 3 else float(rng.randint(1, 40)) + rng.random() for a in ATTRS], "yes" if rng.random() < 0.2 else "no") for i in range(200)]
    nan = spark.createDataFrame(rows, "row_id string, " + ", ".join(f"{a} double" for a in ATTRS) + ", failure string").cache()
    return nan, nan.withColumn("price", F.when(~F.isnan("price"), F.col("price")))


OPERATORS = {
    "C2": lambda d: profile.descriptive_table(d, ATTRS),
    "C3": lambda d: profile.nulls_by_column(d, ATTRS),
    "C4": lambda d: profile.nulls_per_row_hist(d, ATTRS),
    "C5": lambda d: profile.missingness_summary(d, ATTRS),
    "C6": lambda d: profile.nulls_by_class(d, ATTRS, "failure"),
    "C7": lambda d: profile.missingness_reading(d, ATTRS, "failure"),
    "C8": lambda d: profile.physical_anomalies(d, {"price": (5.0, 30.0)}),
    "C9": lambda d: profile.univariate_auc(d, OBS),
    "C14": lambda d: profile.correlation_matrix(d, ATTRS),
    "C15": lambda d: profile.max_abs_corr(d, ATTRS),
    "C16": lambda d: profile.class_histogram(d, ATTRS, "failure"),
    "C17": lambda d: profile.class_boxplot(d, ATTRS, "failure"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_nan_is_null(frames, name):
    got, want = ([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in OPERATORS[name](d).collect()] for d in frames)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert not any(isinstance(v, float) and math.isnan(v) for r in got for v in r)


def test_nan_is_counted_and_left_out(frames):
    d = frames[0]
    assert {r.attr: r.nulls for r in profile.nulls_by_column(d, ATTRS).collect()}["price"] == 20
    assert profile.class_histogram(d, ["price"], "failure").where("bin > 0").count() > 5
    assert profile.class_boxplot(d, ["price"], "failure").agg(F.sum("n_outliers")).first()[0] == 0
