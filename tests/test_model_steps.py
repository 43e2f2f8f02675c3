"""Steps shared by the model queries: what they read, how often, and that they agree with the plain way."""

import os
import random

import pytest
from pyspark.sql import functions as F

from rarefold.functions import cache
from rarefold.functions.ranks import value_prefix
from rarefold.operators import linear, resample, zoo
from rarefold.plans import q_models
from rarefold.session import ensure_checkpoint_dir


@pytest.fixture(scope="module")
def folded(spark):
    rng = random.Random(9)
    data = [(f"k{i}", int(rng.random() < 0.2), None if rng.random() < 0.1 else 300 + rng.random(), rng.gauss(0, 1)) for i in range(600)]
    df = spark.createDataFrame([(a, y, u, v + y) for a, y, u, v in data], "row_id string, y int, u double, v double")
    return resample.stratified_folds(df, "y", k=3, seed=42, keep_rank=True).select("row_id", "rep", "fold", "rank0", "y", "u", "v").cache()


@pytest.mark.parametrize("balanced", [False, True])
def test_cells_are_fitted_from_base_rows(folded, balanced, monkeypatch):
    f = zoo.folded_base(folded, ["u", "v"], 3)
    cells = zoo.outer_cells(f) + zoo.inner_cells(f, zoo.outer_cells(f), (0.1, 1.0)) + zoo.inner_cells(f, zoo.inner_cells(f, zoo.outer_cells(f))[:1])
    prep = zoo.fit_prep(f, cells)
    rows = linear.fit_logistic(zoo.expand(f, zoo.cell_table(f, prep, balanced), "train"), ["cell"], zoo.zs(f), "y", "w", "C").collect()
    monkeypatch.setattr(zoo, "expand", None)  # a fit expands no rows
    got = zoo.fit_cells(f, prep, balanced)
    assert list(got) == list(prep)
    for r in rows:
        mine = got[cells[r.cell]]
        assert [mine[f"b{j}"] for j in range(3)] == pytest.approx([r.b0, r.b1, r.b2], rel=1e-7, abs=1e-9) and mine["conv"] == float(r.converged)


def test_running_sums_are_stored_by_column(spark):
    df = spark.range(1000).select(F.lit(0).alias("g"), F.rand(1).alias("v"), F.lit(1).alias("n"))
    at = ensure_checkpoint_dir(spark)
    before = set(os.listdir(at))
    assert value_prefix(df, ["g"], "v", ["n"]).agg(F.sum("n_before")).first()[0] == 999 * 500
    new = [x for x in set(os.listdir(at)) - before if x.startswith("prefix-")]
    assert len(new) == 1 and any(x.endswith(".parquet") for x in os.listdir(os.path.join(at, new[0])))


def test_trees_are_grown_once_for_their_metrics(spark):
    runs = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(i):
        runs.add(1)
        return (i % 7) / 7

    rows = spark.range(70, numPartitions=2).select(F.lit("m").alias("model"), F.lit(0).alias("rep"), F.lit(0).alias("fold"), (F.col("id") % 3 == 0).cast("int").alias("y"), score("id").alias("score"), F.lit(False).alias("capped"))
    rows = rows.withColumn("pred", (F.col("score") > 0.5).cast("int"))
    cache.release()
    assert q_models._metrics(rows, "capped").first().n_test == 70
    assert runs.value <= 2 * 70  # the optimizer may ask for the score once for itself and once for ``pred``


def test_fits_at_once_give_the_same_scores(folded, monkeypatch):
    f = zoo.folded_base(folded, ["u", "v"], 3)
    many = {r.row_id: (r.fold, r.score) for r in zoo.spark_ml_cv(f, "tree_shallow_balanced").collect()}
    monkeypatch.setattr(zoo, "ALONE_ROWS", 0)
    assert {r.row_id: (r.fold, r.score) for r in zoo.spark_ml_cv(f, "tree_shallow_balanced").collect()} == many and len(many) == 600
