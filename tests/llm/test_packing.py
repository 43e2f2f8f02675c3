import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
from tokenizers import Tokenizer

from rarefold.llm import packing, tokens


def base():
    t = Tokenizer.from_file(tokens.tokenizer_path())
    t.encode_special_tokens = True
    return t


def test_ids_are_those_of_the_tokenizer(spark):
    t, rng = base(), random.Random(3)
    texts = ["", " ", "  a", "a  b", " a b ", "a \n b", "<|endoftext|> x", "don't 'll", "x\x1c y", "日本 語  x", "a" * 300 + " b", "\t\ta b\r\n c  "]
    texts += ["".join(rng.choice(" \n\tab1!.é 　\x1c'") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    got = tokens.encoder(tokens.tokenizer_path())(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_plans_hold_every_piece_and_reach_the_optimum_of_small_cases():
    rng = random.Random(1)
    for _ in range(150):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 7))]
        counts = {s: sizes.count(s) for s in sizes}
        plan = packing.completion_plan(counts, 20)
        held = [s for n, c in plan for _ in range(n) for s in c]
        assert sorted(held) == sorted(sizes) and all(sum(c) <= 20 for _, c in plan)
        assert sum(n for n, _ in plan) == min(map(first_fit, permutations(sizes)))


def first_fit(sizes):
    bins = []
    for s in sizes:
        for k, b in enumerate(bins):
            if b + s <= 20:
                bins[k] += s
                break
        else:
            bins.append(s)
    return len(bins)


def check(docs, capacity=2048):
    t = base()
    rows = packing.pack(packing.pieces(docs, tokens.tokenizer_path(), capacity), capacity).collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        k, lo = 0, 0
        hi = len(ids) % capacity or min(len(ids), capacity)
        while lo < len(ids):
            want.append((r.doc_id or -1, k, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes())))
            k, lo, hi = k + 1, hi, hi + capacity
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    at = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return rows, at


def test_pieces_and_places(docs, no_docs):
    check(docs)
    rows, at = check(docs, 64)
    counts = Counter(r.length for r in rows)
    alone = sum(n for s, n in counts.items() if s > 32)  # two of these never share
    assert max(alone, -(-sum(r.length for r in rows) // 64)) <= len(at) <= sum(n for n, _ in packing.best_fit_plan(counts, 64))
    assert packing.pack(packing.pieces(no_docs, tokens.tokenizer_path())).count() == 0


def test_length_histogram(docs, no_docs):
    t = base()
    n = [len(t.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()]
    rows = tokens.length_histogram(tokens.encoded_lengths(docs, tokens.tokenizer_path()), block=7).collect()
    assert sorted(r.length for r in rows) == sorted(set(n))
    for r in rows:
        limit = r.length
        assert (r.n_docs, r.docs_longer, r.docs_total) == (n.count(limit), sum(x > limit for x in n), len(n))
        assert (r.n_tokens, r.tokens_longer, r.tokens_total) == (limit * n.count(limit), sum(x for x in n if x > limit), sum(n))
        assert (r.truncated_total, r.cut_tokens) == (sum(min(x, limit) for x in n), sum(max(x - limit, 0) for x in n))
        assert abs(r.quantile - sum(x <= limit for x in n) / len(n)) < 1e-12
    assert tokens.length_histogram(tokens.encoded_lengths(no_docs, tokens.tokenizer_path())).count() == 0
