"""The tree of all rows: its leaves hold every row, and only label and features are stored for it."""

import random

from rarefold.functions import cache
from rarefold.operators import zoo


def test_leaves_hold_all_rows_and_no_key_or_vector_is_stored(spark):
    rng = random.Random(4)
    rows = [(f"k{i}", 0, i % 5, i, int(rng.random() < 0.3), rng.gauss(0, 1), None if rng.random() < 0.1 else float(rng.randint(0, 4))) for i in range(400)]
    rows = [(*r[:4], int(r[5] > 0.5 or r[4] and r[5] > 0), *r[5:]) for r in rows]
    df = spark.createDataFrame(rows, "row_id string, rep int, fold int, rank0 long, y int, a double, b double")
    before = len(cache._KEPT)
    leaves, info = zoo.tree_leaf_table(df, ["a", "b"])
    kept = cache._KEPT[before:]
    got = leaves.collect()
    assert sum(r.n for r in got) == 400 and sum(r.n_pos for r in got) == sum(r[4] for r in rows)
    assert info["root_attr"] == "a" and 1 <= info["depth"] <= 3 and len(got) == (info["num_nodes"] + 1) // 2
    assert len(kept) == 1 and set(kept[0].columns) == {"row_id", "rep", "fold", "rank0", "y", "a", "b"}
    assert kept[0].where("row_id is not null or rank0 <> 0").count() == 0
