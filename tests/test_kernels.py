"""The two-level prefix kernel equals the single-window answer; folds are exact and stratified."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from rarefold.functions.ranks import exclusive_prefix, float_bucket, value_prefix
from rarefold.operators import resample


def test_prefix_equals_plain_window(spark):
    random.seed(1)
    vals = [random.choice([-1e6, -3.5, -1e-9, 0.0, 1e-300, 0.25, 1.0, 2.0, 7.77, 1e12]) * random.random() for _ in range(3000)]
    rows = [(g, v, 1) for g in ("a", "b") for v in sorted(set(vals))]
    df = spark.createDataFrame(rows, "g string, v double, c int")
    got = exclusive_prefix(df, ["g"], ["v"], float_bucket(F.col("v")), ["c"]).select("g", "v", "c_before")
    w = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    exp = df.select("g", "v", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("c_before"))
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_float_bucket_is_monotone(spark):
    xs = sorted({(-1) ** i * (2.0 ** e) * m for i in range(2) for e in range(-60, 60, 7) for m in (1.0, 1.0000001, 1.5, 1.9999999)} | {0.0})
    df = spark.createDataFrame([(x,) for x in xs], "v double").withColumn("b", float_bucket(F.col("v")))
    bs = [r.b for r in df.orderBy("v").collect()]
    assert bs == sorted(bs)


def test_stratified_folds_are_balanced(spark):
    rows = [(f"k{i}", 1 if i % 20 == 0 else 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "row_id string, y int")
    f = resample.stratified_folds(df, "y", k=5, seed=42)
    counts = {(r.fold, r.y): r["count"] for r in f.groupBy("fold", "y").count().collect()}
    assert sorted(counts[(k, 1)] for k in range(5)) == [10] * 5
    assert sorted(counts[(k, 0)] for k in range(5)) == [190] * 5
    assert f.select("row_id").distinct().count() == 1000


def test_ranks_far_apart_bring_few_rows_to_the_driver(spark, monkeypatch):
    import numpy as np

    from rarefold.functions import brackets

    df = spark.range(20000).selectExpr("cast(id % 3 as int) AS g", "cast(conv(substr(md5(cast(id as string)), 1, 13), 16, 10) as double) AS x", "if(id % 4 = 0, null, cast(id % 7 as double)) AS y")
    brought = []
    real = brackets._exact

    def spy(*args):
        out = real(*args)
        brought.append(sum(len(x) for x in out) if isinstance(out, list) else sum(map(len, out.values())))
        return out

    monkeypatch.setattr(brackets, "_exact", spy)
    sets = {"all": lambda g: True, "odd": lambda g: g[0] == 1, "rest": lambda g: g[0] != 1, "none": lambda g: False}
    found, sizes = brackets.set_ranks(df, ["g"], ["x", "y"], sets, lambda s, n: [int(p * (n - 1)) for p in (0, 0.25, 0.4, 0.55, 0.85, 1)], few=600)
    assert max(brought) <= 2 * 600
    rows = df.collect()
    for s, member in sets.items():
        for a in ("x", "y"):
            want = np.sort([r[a] for r in rows if member((r.g,)) and r[a] is not None])
            assert sizes[s, a] == len(want)
            for p in (0, 0.25, 0.4, 0.55, 0.85, 1) if len(want) else ():
                assert found[s, a, int(p * (len(want) - 1))] == want[int(p * (len(want) - 1))]


def test_value_prefix_equals_a_plain_window(spark):
    """Narrow ranges, crowded scores, several groups; both directions, many tasks."""
    import random

    rng = random.Random(2)
    rows = {(rng.choice(["a", "b", "c"]), rng.choice([295 + 10 * rng.random(), 1 - rng.random() ** 8 * 1e-9, -rng.random()])): (rng.randint(0, 5), rng.random()) for _ in range(5000)}
    df = spark.createDataFrame([(g, v, *x) for (g, v), x in rows.items()], "g string, v double, c long, d double").repartition(7)
    for down in (False, True):
        want = {}
        for g in "abc":
            c = d = 0
            for v in sorted((v for h, v in rows if h == g), reverse=down):
                want[g, v] = (c, d)
                c, d = c + rows[g, v][0], d + rows[g, v][1]
        got = {(r.g, r.v): (r.c_before, r.d_before) for r in value_prefix(df, ["g"], "v", ["c", "d"], descending=down).collect()}
        assert got.keys() == want.keys()
        assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_narrow_values_spread_over_all_tasks(spark):
    from pyspark.sql import functions as F

    df = spark.range(40_000).select(F.lit("a").alias("g"), (300 + F.col("id") * 1e-9).alias("v"), F.lit(1).alias("c"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = df.repartitionByRange("g", F.col("v").asc()).groupBy(F.spark_partition_id()).count().collect()
        assert value_prefix(df, ["g"], "v", ["c"]).agg(F.max("c_before")).first()[0] == 39_999
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert max(r["count"] for r in dealt) < 2 * 40_000 / len(dealt) and len(dealt) > 1


def test_value_prefix_loses_no_row_of_an_unpivoted_table(spark):
    """The kernel joins its own output; more rows than one Arrow batch, columns that are renamed in the join."""
    df = spark.range(30_000).select((F.col("id") % 997).cast("double").alias("a"), F.col("id").cast("double").alias("b")).unpivot([], ["a", "b"], "attr", "v")
    g = df.groupBy("attr", "v").agg(F.count("*").alias("n"))
    out = value_prefix(g, ["attr"], "v", ["n"]).groupBy("attr").agg(F.sum("n").alias("n"), F.max("n_before").alias("m"), F.count("*").alias("c")).collect()
    assert {r.attr: (r.n, r.m, r.c) for r in out} == {"a": (30_000, 29_970, 997), "b": (30_000, 29_999, 30_000)}
