"""Exact isotonic fits against a plain pooling loop; exact Mann-Whitney against full enumeration; whole-table fill."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from rarefold.functions.stats import mann_whitney_exact_p
from rarefold.operators import isotonic, prep, profile
from rarefold.spec import OBS


def plain(x, y):
    """Fitted value of every distinct x."""
    xs, fit = sorted(set(x)), []
    for v in xs:
        mine = [b for a, b in zip(x, y) if a == v]
        fit.append([sum(mine), len(mine), 1])
        while len(fit) > 1 and fit[-2][0] * fit[-1][1] >= fit[-1][0] * fit[-2][1]:
            last = fit.pop()
            fit[-1] = [p + q for p, q in zip(fit[-1], last)]
    return xs, [p / n for p, n, k in fit for _ in range(k)]


def test_blocks_equal_the_plain_loop_however_rows_are_dealt(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g, n, step in ((0, 700, None), (1, 900, 0.25), (3, 1, None), (4, 400, 1.0)):
        x = rng.normal(0, 2, n) if step is None else np.round(rng.normal(0, 2, n) / step) * step
        y = rng.random(n) < 1 / (1 + np.exp(-x))
        rows += [(g, float(a), int(b)) for a, b in zip(x, y)]
    rows += [(4, float(i), 1 - i % 2) for i in range(40)]
    odd = [(1, None, 1), (1, math.nan, 1), (1, 0.5, None), (2, None, 0)]
    seen = []
    for parts in (1, 3, 8):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = spark.createDataFrame(rows + odd, "cell int, m double, y int").repartition(parts)
        seen.append(isotonic.isotonic_blocks(df, "cell", "m", "y").toPandas().sort_values(["cell", "lo"]).reset_index(drop=True))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert all(s.equals(seen[0]) for s in seen) and set(seen[0].cell) == {0, 1, 3, 4}
    for g, blocks in seen[0].groupby("cell"):
        xs, want = plain([r[1] for r in rows if r[0] == g], [r[2] for r in rows if r[0] == g])
        assert np.interp(xs, *isotonic.knots(blocks)).tolist() == pytest.approx(want, abs=1e-12)
    none = spark.createDataFrame([], "cell int, m double, y int")
    assert isotonic.isotonic_blocks(none, "cell", "m", "y").count() == 0
    assert np.interp(0.3, *isotonic.knots(pd.DataFrame())) == 0


def test_the_loop_and_the_passes_agree(monkeypatch):
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 500):
        x, n_x = np.arange(n, dtype=float), rng.integers(1, 9, n)
        pos = rng.integers(0, n_x + 1)
        monkeypatch.setattr(isotonic, "PASSES", 32)
        want = isotonic.pool(x, x, pos, n_x)
        monkeypatch.setattr(isotonic, "PASSES", 0)
        got = isotonic.pool(x, x, pos, n_x)
        assert all(a.tolist() == b.tolist() for a, b in zip(got, want))


def enumerated(u, n1, n2):
    """Two-sided p over all ways to choose the ranks of the first group."""
    low = n1 * (n1 + 1) // 2
    us = [sum(r) - low for r in combinations(range(1, n1 + n2 + 1), n1)]
    far = max(u, n1 * n2 - u)
    return min(1.0, 2 * sum(v >= far for v in us) / len(us))


@pytest.mark.parametrize("n1", range(1, 9))
def test_exact_p_equals_full_enumeration(n1):
    for n2 in range(1, 9):
        for u in range(n1 * n2 + 1):
            assert mann_whitney_exact_p(u, n1, n2) == pytest.approx(enumerated(u, n1, n2), rel=1e-12) if n1 + n2 <= 12 or u % 7 == 0 else True


def test_exact_p_at_large_sizes():
    assert mann_whitney_exact_p(0, 1, 10**15) == pytest.approx(2 / (10**15 + 1), rel=1e-12)
    assert mann_whitney_exact_p(10**15 // 2, 1, 10**15) == 1.0
    n = 10**7  # U / n goes to the sum of eight uniform numbers
    limit = sum((-1) ** k * math.comb(8, k) * (1.6 - k) ** 8 for k in range(2)) / math.factorial(8)
    assert mann_whitney_exact_p(int(0.2 * 8 * n), 8, n) == pytest.approx(2 * limit, rel=1e-5)


def test_exact_branch_is_taken_without_ties_and_with_a_small_class(spark):
    small = [(float(i), float(i % 3), "yes" if i in (2, 5, 11) else "no") for i in range(14)]
    df = spark.createDataFrame(small, "qty double, price double, failure string")
    df = df.select("*", *[(df.qty * 0).alias(c) for c in OBS.numeric_attributes() if c not in df.columns])
    r = {x.attr: x for x in profile.univariate_auc(df, OBS).collect()}
    assert r["qty"].p_exact and not r["price"].p_exact
    assert r["qty"].p_value == pytest.approx(enumerated(int(r["qty"].u), 3, 11), rel=1e-12)


def test_naive_fill_is_the_whole_tables_median(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", math.nan, None), ("c", 5.0, None), ("c", 9.0, None)], "k string, x double, e double")
    got = sorted(tuple(r) for r in prep.naive_fill(df, ["x", "e"], ["k"]).collect())
    assert got == [("a", 1.0, None), ("b", 5.0, None), ("c", 5.0, None), ("c", 9.0, None)]
