import math
from collections import Counter

import duckdb
import pytest

from rarefold.llm import mixing


def test_equals_its_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    want = con.execute(mixing.ORACLE_OP5).fetchall()
    got = [tuple(r) for r in mixing.op5_mixing(spark, d).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("target", [mixing.Target(evenness=0.9, block_tokens=500), mixing.Target(evenness=1.0, max_repeats=1.5), mixing.Target(evenness=0.0, budget=90_000)])
def test_weights_budgets_and_blocks(docs, target):
    rows = mixing.mix(docs, target).collect()
    base = mixing.sized(docs).collect()
    total, own = sum(r.tokens for r in base), Counter()
    for r in base:
        own[r.source] += r.tokens
    weight = {r.source: r.weight for r in rows}
    budget = target.budget or total
    used = Counter()
    for r in rows:
        used[r.source] += r.tokens
    longest = max(r.tokens for r in base)
    for s, w in weight.items():
        assert used[s] <= math.floor(w * budget) + 1 and used[s] > w * budget - longest
    if target.evenness == 0:
        assert all(abs(weight[s] - own[s] / total) < 1e-6 for s in weight)
    else:
        assert max(w * budget / own[s] for s, w in weight.items()) <= target.max_repeats + 1e-6
    places = Counter((r.block, r.place) for r in rows)
    assert max(places.values()) == 1
    for b in {r.block for r in rows}:
        assert sorted(r.place for r in rows if r.block == b) == list(range(1, 1 + sum(r.block == b for r in rows)))


def test_one_source_and_none(spark, docs, no_docs):
    one = docs.where("source = 's3'")
    assert {r.weight for r in mixing.mix(one).collect()} == {1.0}
    assert mixing.mix(no_docs).count() == 0
