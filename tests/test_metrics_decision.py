"""Goldens on the published out-of-fold scored vector (179 rows, 10 positives)."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rarefold.operators import decision, limits, linear, metrics
from rarefold.spec import COSTS

HERE = os.path.dirname(os.path.abspath(__file__))


@pytest.fixture(scope="module")
def scored(spark):
    d = json.load(open(os.path.join(HERE, "fixtures", "scored_vector.json")))
    rows = [(str(i), int(y), float(s), int(s > 0.5)) for i, (y, s) in enumerate(zip(d["y_true"], d["y_score"]))]
    return spark.createDataFrame(rows, "row_id string, y int, score double, pred int").withColumn("g", F.lit("m")).cache()


def test_brier_and_decomposition(scored):
    b = decision.brier_decomposition(scored, ["g"]).first()
    assert b.brier_score == pytest.approx(0.037045684589637896, abs=1e-12)
    assert b.reliability == pytest.approx(0.00791484999534466, abs=1e-12)
    assert b.resolution == pytest.approx(0.022800786492306727, abs=1e-12)
    assert b.uncertainty == pytest.approx(0.052744920570519015, abs=1e-12)


def test_average_precision_step(scored):
    ap = metrics.average_precision(scored, ["g"]).first().average_precision
    assert ap == pytest.approx(0.5837929869483268, abs=1e-12)


def test_cost_curve_and_optimal_threshold(scored):
    curve = decision.cost_curve(scored, ["g"])
    c = {round(r.threshold, 3): r.cost for r in curve.collect()}
    assert c[0.5] == pytest.approx(100_500_000)
    assert min(c.values()) == pytest.approx(29_000_000)
    e = decision.expected_cost(scored, ["g"], COSTS.theoretical_threshold()).first()
    assert e.cost == pytest.approx(49_000_000)
    o = decision.optimal_threshold(scored, ["g"]).first()
    assert o.optimal_threshold == pytest.approx(0.126, abs=1e-9) and o.n_tied == 5
    assert COSTS.theoretical_threshold() == pytest.approx(0.0556, abs=1e-4)


def test_reliability_keeps_empty_bins(spark):
    df = spark.createDataFrame([(0, 0.05), (0, 0.06), (1, 0.95), (1, 0.96)], "y int, score double").withColumn("g", F.lit("m"))
    r = decision.reliability_curve(df, ["g"]).orderBy("bin").collect()
    assert len(r) == 10 and [x.n for x in r] == [2, 0, 0, 0, 0, 0, 0, 0, 0, 2]
    assert r[1].mean_predicted is None


def test_tiny_cost_examples(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.6), (0, 0.2)], "y int, score double").withColumn("g", F.lit("m"))
    assert decision.expected_cost(df, ["g"], 0.0).first().cost == pytest.approx(4_000_000)
    assert decision.expected_cost(df, ["g"], 1.01).first().cost == pytest.approx(20_000_000)


def test_wilson_and_power(spark):
    df = spark.createDataFrame([(8, 10), (0, 0)], "k long, n long")
    r = metrics.wilson_ci(df, "k", "n").collect()
    assert r[0].ci_low == pytest.approx(0.490, abs=1e-3) and r[0].ci_high == pytest.approx(0.943, abs=1e-3)
    assert r[1].ci_low is None
    seg = spark.createDataFrame([("a", 179, 10, 10 / 179), ("b", 18, 1, 1 / 18)], "seg string, n long, n_pos long, prevalence double")
    out = {(x.seg, x.margin): x for x in limits.required_positives(seg, limits.scenarios(spark)).collect()}
    assert out[("a", 0.10)].positives_needed == 62 and out[("a", 0.05)].positives_needed == 246
    assert out[("a", 0.10)].observations_needed == 1110
    assert out[("b", 0.10)].observations_needed == 1116


def test_bootstrap_ci_degenerate(spark):
    vals = spark.createDataFrame([("m", "ap", i, 0.6554) for i in range(50)], "model string, metric string, fold int, value double")
    ci = metrics.bootstrap_ci(vals, ["model", "metric"], ["fold"], n_boot=200).first()
    assert ci.ci_low == pytest.approx(0.6554) and ci.ci_high == pytest.approx(0.6554)


def test_irls_matches_numpy_newton(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    y = (rng.uniform(size=400) < 1 / (1 + np.exp(-(0.5 + x[:, 0] - 2 * x[:, 1])))).astype(int)
    w = np.where(y == 1, 2.0, 1.0)
    df = spark.createDataFrame([(0, float(a), float(b), int(c), float(d)) for (a, b), c, d in zip(x, y, w)], "cell int, a double, b double, y int, w double")
    got = linear.fit_logistic(df, ["cell"], ["a", "b"], "y", "w", 1.0).first()
    X = np.c_[np.ones(400), x]
    beta = np.zeros(3)
    pen = np.array([0.0, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-X @ beta))
        g = X.T @ (w * (p - y)) + pen * beta
        H = X.T @ (X * (w * p * (1 - p))[:, None]) + np.diag(pen)
        beta -= np.linalg.solve(H, g)
    assert [got.b0, got.b1, got.b2] == pytest.approx(list(beta), abs=1e-6)
