"""Ranks by hash: equal to plain sorting, without storing or widening the rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from rarefold.functions import cache
from rarefold.functions.ranks import hash_rank
from rarefold.operators import prep, resample
from rarefold.plans import q_metrics


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [(f"k{i}", rng.choice(["yes", "no", "no", None]), rng.gauss(0, 1), "x" * 50) for i in range(3000)]
    return spark.createDataFrame(data, "row_id string, failure string, v double, wide string"), data


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def test_ranks_and_sums_equal_sorting(rows):
    df, data = rows
    h = F.md5(F.concat_ws("|", F.lit("s"), "row_id"))
    got = hash_rank(df.withColumn("c", F.length("row_id")), ["failure"], h, ["c"]).collect()
    want = {}
    for label in ("yes", "no"):
        before = 0
        for i, k in enumerate(sorted((d[0] for d in data if d[1] == label), key=lambda k: md5("s", k))):
            want[k] = (i, before)
            before += len(k)
    assert {r.row_id: (r.rank0, r.c_before) for r in got} == want  # rows without label take no part


def test_ranking_stores_nothing_and_carries_only_what_is_read(rows):
    df, _ = rows
    cache.release()
    f = resample.stratified_folds(df, "failure")
    counted = resample.fold_expansion(f, 5).groupBy("outer", "role").count()
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert not cache._KEPT and not any("wide" in x for x in plan.splitlines() if "LogicalRDD" not in x)
    assert {(r.outer, r.role) for r in counted.collect()} == {(o, x) for o in range(5) for x in ("train", "test")}


def test_learning_subsets_rank_the_base_rows_once(rows):
    df, data = rows
    f = resample.stratified_folds(df, "failure", k=3).cache()
    s = resample.learning_subsets(f, 3)
    held = {r.row_id: r.fold for r in f.collect()}
    got = {(r.row_id, r.outer): (r.rank0, r.size_idx) for r in s.collect()}
    for o in range(3):
        train = sorted((k for k, x in held.items() if x != o), key=lambda k: md5(42, "lc", k))
        sizes = [int(x * len(train)) for x in resample.LEARNING_FRACTIONS]
        for i, k in enumerate(train):
            assert got.get((k, o)) == next(((i, j) for j, n in enumerate(sizes) if i < n), None)
    # the windows that sort rows are below the expansion into outer folds
    plan = s._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Cross") < plan.index("Window") if "Join Cross" in plan else plan.index("Join Inner") < plan.index("Window")
    f.unpersist()


def test_fixed_models_are_made_in_flight(spark, rows, monkeypatch):
    df, data = rows
    obs = df.select("row_id", "failure", F.lit(1).alias("line"), F.lit(2.0).alias("qty"), F.lit(0.1).alias("disc")).where("failure is not null")
    monkeypatch.setattr(q_metrics, "valid", lambda *a: obs)
    cache.release()
    assert q_metrics.scored_models(spark, None).count() == 4 * obs.count()
    assert all(x.count() <= obs.count() for x in cache._KEPT)


def test_standardizing_stores_no_keys(rows):
    df, _ = rows
    cache.release()
    got = prep.foldwise_standardize(resample.stratified_folds(df, "failure"), ["v"], 5)
    assert got.count() == 5 and [x.columns for x in cache._KEPT] == [["rep", "fold", "v"]]
