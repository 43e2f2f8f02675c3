"""Cells, bracketed quantiles and Newton fits against plain numpy."""

import math
import random

import numpy as np
import pytest

from rarefold.functions import cache
from rarefold.functions.brackets import set_quantiles
from rarefold.functions.ranks import float_bucket
from rarefold.functions.stats import hypergeom_cdf
from rarefold.operators import linear, profile, resample, zoo


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = [(f"k{i}", int(rng.random() < 0.2), None if rng.random() < 0.1 else 300 + rng.random(), rng.gauss(0, 1)) for i in range(900)]
    df = spark.createDataFrame([(a, y, u, v + y) for a, y, u, v in data], "row_id string, y int, u double, v double")
    folded = resample.stratified_folds(df, "y", k=5, seed=42, keep_rank=True).select("row_id", "rep", "fold", "rank0", "y", "u", "v").cache()
    return folded, folded.toPandas()


def test_brackets_equal_numpy(spark):
    rng = random.Random(1)
    values = [rng.choice([math.nan, None, 295 + 10 * rng.random(), 299.5, -math.inf, math.inf, 1e-300]) for _ in range(4000)]
    df = spark.createDataFrame([(i % 3, x) for i, x in enumerate(values)], "g int, x double")
    sets = {"all": lambda g: True, "two": lambda g: g[0] != 1}
    got = set_quantiles(df, ["g"], ["x"], sets, (0.1, 0.5, 0.83), few=50)
    for s, member in sets.items():
        mine = np.array([max(min(x, 1.7976931348623157e308), -1.7976931348623157e308) for i, x in enumerate(values) if x is not None and not math.isnan(x) and member((i % 3,))])
        for q in (0.1, 0.5, 0.83):
            with np.errstate(over="ignore"):
                assert got[s, "x", q] == pytest.approx(float(np.quantile(mine, q)), rel=1e-12)


def test_inner_and_calibration_cells_are_stratified_partitions(rows):
    f = zoo.folded_base(rows[0], ["u", "v"], 5)
    for parent in zoo.outer_cells(f):
        for cells in (zoo.inner_cells(f, [parent]), zoo.inner_cells(f, zoo.inner_cells(f, [parent])[:1])):
            top = parent if cells[0].cal < 0 else zoo.inner_cells(f, [parent])[0]
            whole = sum(v[0] for g, v in f.counts().items() if f.trains(top, g))
            left = [{y: sum(v[0] for g, v in f.counts().items() if f.trains(top, g) and not f.trains(c, g) and g[3] == y) for y in (0, 1)} for c in cells]
            assert sum(x[0] + x[1] for x in left) == whole
            assert max(x[1] for x in left) - min(x[1] for x in left) <= 1 and max(x[0] for x in left) - min(x[0] for x in left) <= 1


def newton(x, y, w, steps=60, c=1.0):
    x = np.column_stack([np.ones(len(x)), x])
    b, pen = np.zeros(x.shape[1]), np.r_[0, np.full(x.shape[1] - 1, 1 / c)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ b))
        b = b - np.linalg.solve((x.T * (w * p * (1 - p))) @ x + np.diag(pen), x.T @ (w * (p - y)) + pen * b)
    return b


def scaled(t, train):
    out = []
    for c in ("u", "v"):
        m = t.loc[train, c].median()
        z = t[c].fillna(m)
        out.append((z - z[train].mean()) / z[train].std(ddof=0))
    return np.column_stack(out)


def test_balanced_scores_equal_numpy(rows):
    folded, t = rows
    got = zoo.logistic_cv(zoo.folded_base(folded, ["u", "v"], 5), balanced=True).toPandas().set_index("row_id")
    assert got.converged.all() and len(got) == len(t)
    for o in range(5):
        train = (t.fold != o).to_numpy()
        x, y = scaled(t, train), t.y.to_numpy()
        n, pos = train.sum(), y[train].sum()
        w = np.where(y == 1, n / (2 * pos), n / (2 * (n - pos)))
        b = newton(x[train], y[train], w[train])
        p = 1 / (1 + np.exp(-(np.column_stack([np.ones(len(x)), x]) @ b)))
        assert np.abs(got.loc[t.row_id[~train]].score.to_numpy() - p[~train]).max() < 1e-6


def test_nothing_stored_is_larger_than_the_base(rows, monkeypatch):
    stored = []
    real = cache.keep
    for mod in (zoo,):
        monkeypatch.setattr(mod, "keep", lambda df: stored.append(df) or real(df))
    f = zoo.folded_base(rows[0], ["u", "v"], 5)
    zoo.logistic_cv(f, True).count()
    zoo.grid_search_c(f).count()
    zoo.calibrated_scores(f, zoo.outer_cells(f), ("platt", "isotonic"), True, True).count()
    assert stored and all(df.count() <= len(rows[1]) for df in stored)


def test_calibrated_scores_are_probabilities_of_all_rows(rows):
    f = zoo.folded_base(rows[0], ["u", "v"], 5)
    t = zoo.calibrated_scores(f, zoo.outer_cells(f), ("platt", "isotonic"), True, False).toPandas()
    assert sorted(t.groupby("model").size()) == [len(rows[1])] * 3
    assert t.score.between(0, 1).all()
    err = t.assign(e=(t.score - t.y) ** 2).groupby("model").e.mean()
    assert err["logistic_plain_platt"] < 0.16 and err["logistic_plain_isotonic"] < 0.16


def test_separable_data_stays_finite(spark):
    df = spark.createDataFrame([(0, float(i), int(i > 4), 1e8) for i in range(10)], "cell int, a double, y int, C double")
    r = linear.fit_logistic(df, ["cell"], ["a"], "y", None, "C").first()
    assert math.isfinite(r.b0) and math.isfinite(r.b1)


def test_nan_counts_as_null(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (3.0,)], "x double")
    r = profile.descriptive_table(df, ["x"]).first()
    assert (r.n, r.nulls, r["mean"], r["median"], r["max"]) == (2, 1, 2.0, 2.0, 3.0)


def test_infinities_have_buckets(spark):
    df = spark.createDataFrame([(-math.inf,), (-1.0,), (0.0,), (1e308,), (math.inf,)], "v double")
    b = [r.b for r in df.select("v", float_bucket(df.v).alias("b")).orderBy("v").collect()]
    assert b == sorted(b) and len(set(b)) == 5


def test_hypergeometric_at_large_counts():
    n, k, d, x = 10**14, 3 * 10**12, 1000, 30
    p = k / n
    want = sum(math.comb(d, i) * p**i * (1 - p) ** (d - i) for i in range(x + 1))
    assert hypergeom_cdf(x, n, k, d) == pytest.approx(want, rel=1e-6)
    exact = sum(math.comb(10, i) * math.comb(20, 8 - i) for i in range(3)) / math.comb(30, 8)
    assert hypergeom_cdf(2, 30, 10, 8) == pytest.approx(exact, rel=1e-12)


def test_forest_and_boosting_keep_their_depth_and_bins(spark):
    from rarefold.operators import forest, zoo

    boosting, model = zoo._estimator("gradient_boosting", 42), forest.MODELS["rf_balanced"]
    assert model.depth is None and forest.BINS >= 128 and model.trees == 100
    assert boosting.getMaxBins() >= 128 and boosting.getMaxIter() == 100
