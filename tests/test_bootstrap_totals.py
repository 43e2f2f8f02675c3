"""Poisson bootstrap totals: hashes of whole columns against hashlib, totals against the draws row by row, no row written out per replicate."""

import bisect
import hashlib
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from rarefold.functions.md5 import Tails
from rarefold.operators import resample


def test_first_words_are_those_of_hashlib():
    rng = random.Random(1)
    tails = [rng.randbytes(rng.choice([0, 1, 3, 33, 44, 45, 46, 47, 53, 54, 55, 56, 64, 120, 200])) for _ in range(400)]
    for part in (tails, [b"|same"] * 5, [b"x"], []):
        for beginning in (b"", b"4", b"42|boot|7", b"42|boot|17", b"42|boot|299", b"y" * 70):
            got = Tails(part).first_words(beginning)
            assert got.tolist() == [int.from_bytes(hashlib.md5(beginning + t).digest()[:4], "little") for t in part]


def test_totals_equal_the_draws_of_every_row(spark):
    rows = [(f"k{i % 700}", (None, "no", "no", "yes")[i % 4]) for i in range(900)] + [(None, "no"), ("a" * 70, "yes")]
    df = spark.createDataFrame(rows, "row_id string, y string")
    cdf, want = resample.poisson1_cdf(), defaultdict(list)
    for k, y in rows:
        for b in range(12):
            h = hashlib.md5("|".join(["7", "boot", str(b), *([] if k is None else [k])]).encode()).hexdigest()
            want[b, y].append(bisect.bisect_right(cdf, int(h[:13], 16) / 16**13))
    want = {g: (len(w), sum(w), sum(x > 0 for x in w), max(w)) for g, w in want.items()}
    totals = resample.bootstrap_totals(df.repartition(3), "y", 12, 7)
    assert {(r.b, r.y): tuple(r)[2:] for r in totals.collect()} == want
    assert [f.dataType.simpleString() for f in totals.schema] == ["int", "string", "bigint", "bigint", "bigint", "int"]
    assert "Generate" not in totals._jdf.queryExecution().optimizedPlan().toString()
    weights = resample.stratified_bootstrap(df, "y", 12, 7).groupBy("b", "y").agg(F.sum("w"), F.sum("weight"))
    assert {(r.b, r.y): (r[2], round(r[3], 6)) for r in weights.collect()} == {g: (w[1], w[0]) for g, w in want.items() if g[1]}


def test_hashes_that_their_first_bytes_do_not_decide_are_read_on():
    table, edges = resample._draw_table(), 0
    for first in range(1 << 16):
        little = int.from_bytes(first.to_bytes(2, "big"), "little")
        low, high = resample._draw_of(np.array([first << 36, (first + 1 << 36) - 1]))
        edges += int(low != high)
        assert table[little] == (low if low == high else resample.UNDECIDED)
    assert 0 < edges <= len(resample.poisson1_cdf())
