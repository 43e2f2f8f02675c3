import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from rarefold.llm import simhash


def plain(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(codes, limit=3):
    near = np.bitwise_count(codes[:, None] ^ codes[None]) <= limit
    label = np.arange(len(codes))
    while True:
        new = np.array([label[r].min() for r in near])
        if (new == label).all():
            return label
        label = new


def clustered(seed, centres=60):
    rng = random.Random(seed)
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            x = c
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return np.array(sorted(out), np.uint64)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="aAb é\t\n  日", max_size=40), min_size=1, max_size=8))
def test_fingerprints_equal_the_plain_definition(texts):
    got = simhash.fingerprints_of([t.encode() for t in texts])
    assert [int(x) for x in got] == [plain(t) for t in texts]


@pytest.mark.parametrize("seed", range(3))
def test_index_finds_every_link_of_a_bucket(seed):
    codes = clustered(seed)
    u, v = simhash.bucket_links(np.zeros(len(codes), int), codes)
    root = simhash._components(len(codes), np.searchsorted(codes, u), np.searchsorted(codes, v))
    assert _same(root, components(codes))


@pytest.mark.parametrize("heavy", [4096, 3])
def test_links_across_buckets_and_split_hot_buckets(spark, heavy):
    codes = clustered(9)
    df = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fp long")
    root = {r.node: r.root for r in simhash.connected(simhash.hamming_links(df, heavy=heavy)).collect()}
    assert _same([root.get(x, x) for x in codes.view(np.int64).tolist()], components(codes))


def _same(a, b):
    first, second = {}, {}
    return [first.setdefault(x, len(first)) for x in a] == [second.setdefault(x, len(second)) for x in b]


def test_awkward_rows(docs, no_docs):
    rows = simhash.near_duplicates(docs).collect()
    base = docs.select("doc_id", "text").collect()
    assert sorted((r.doc_id or -1, r.fp & (2**64 - 1)) for r in rows) == sorted((r.doc_id or -1, plain(r.text)) for r in base)
    by = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    codes = np.array(sorted({plain(r.text) for r in base}), np.uint64)
    group = dict(zip(codes.tolist(), components(codes).tolist(), strict=True))
    least = {}
    for r in base:
        if r.doc_id is not None:
            g = group[plain(r.text)]
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
    assert by == {r.doc_id: least[group[plain(r.text)]] for r in base if r.doc_id is not None}
    assert by[1] == by[2] == 1 and by[6] == by[7] == by[8] == 6
    assert simhash.near_duplicates(no_docs).count() == 0
