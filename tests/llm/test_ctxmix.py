import math
import re
import zlib
from collections import Counter

import numpy as np

from rarefold.llm import ctxmix


def words(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()), b" "]


def check(spark, docs):
    model, vocabulary = ctxmix.learn(docs.select("doc_id", "text"))
    out = ctxmix.score(docs.select("doc_id", "text"), model, vocabulary).collect()
    base = docs.select("doc_id", "text").collect()
    count = Counter()
    for r in base:
        if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            count.update(words(r.text))
    n, v = sum(count.values()), len(count)
    want = sorted((r.doc_id or -1, len(words(r.text)), sum(count[w] > 0 for w in words(r.text)), round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words(r.text)), 5)) for r in base)
    got = sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in out)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert max(abs(g[3] - w[3]) for g, w in zip(got, want)) < 1e-4
    assert all(r.score <= 1e-9 and r.train_tokens == n for r in out)
    return out, model


def test_counts_and_base_exactly_awkward_rows(spark, docs, no_docs):
    out, _ = check(spark, docs)
    assert len(out) == docs.count()
    model, vocabulary = ctxmix.learn(no_docs.select("doc_id", "text"))
    assert ctxmix.score(no_docs, model, vocabulary).count() == 0
    lone = ctxmix.score(docs.where("doc_id = 1"), model, vocabulary).first()
    assert lone.score == 0 and lone.base_score == 0 and lone.n_known == 0


def test_held_out_texts_beat_the_base_with_rare_words_apart(spark, monkeypatch):
    monkeypatch.setattr(ctxmix, "HEAD", 500)
    monkeypatch.setitem(ctxmix.head_words.__globals__, "HEAD", 500)
    ctxmix.head_words.__defaults__ = (500,)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out, model = check(spark, docs)
    assert len(model.code.hashes) <= 500
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    ctxmix.head_words.__defaults__ = (1 << 16,)


def test_bits_of_all_symbols_are_a_distribution():
    """Over every possible next symbol the coded probabilities sum to one."""
    text = b"a b c a b d a b c a c b a b"
    h, _ = ctxmix.word_hashes([text])
    hashes, counts = np.unique(np.r_[h, ctxmix.END], return_counts=True)
    code = ctxmix.build_code(hashes, counts, int(counts.sum()), len(counts))
    rng = np.random.default_rng(0)
    size = 1 << ctxmix.TABLE_BITS
    model = ctxmix.fit_mixer([text], code, rng.integers(0, 3, (ctxmix.TABLES, size)).astype(np.float32), rng.integers(0, 3, (ctxmix.TABLES, size)).astype(np.float32))
    s = ctxmix.read([text], code)
    at = len(s.hash) - 1
    total = 0.0
    for symbol in range(len(code.counts)):
        s.symbol[at] = symbol
        e = ctxmix.bits(s, code, at, at + 1)
        x, gate = ctxmix.inputs(s, code, e, model.odds, model.sure[2], e.slot)
        q = ctxmix._refine((model.weights[:, gate] * x).sum(0), e.depth, model.map)
        total += float(np.prod(np.where(e.bit, q, 1 - q)))
    assert abs(total - 1) < 1e-5


def small_model(texts):
    h, _ = ctxmix.word_hashes(texts)
    hashes, counts = np.unique(np.r_[h, np.full(len(texts), ctxmix.END)], return_counts=True)
    code = ctxmix.build_code(hashes, counts, int(counts.sum()), len(counts))
    zero = np.zeros((ctxmix.TABLES, 1 << ctxmix.TABLE_BITS), np.float32)
    return ctxmix.fit_mixer(texts, code, zero, zero)


def test_every_training_text_shapes_the_mixer_to_its_end(spark):
    """More than 600 texts, and a text's part after 20,000 characters, are seen."""
    rows = [(i, "a b " * 12 + f"c{i % 5}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    real = ctxmix._model

    def spy(code, n0, n1, w, sums):
        seen.append((sums[ctxmix.SUMS[1] : ctxmix.SUMS[2]].sum(), int((code.length * code.counts)[:-1].sum())))
        return real(code, n0, n1, w, sums)

    ctxmix._model = spy
    try:
        ctxmix.learn(docs)
        ctxmix.learn(spark.createDataFrame([(1, "a b c d " * 20000), (4, "x y")], "doc_id long, text string"))
    finally:
        ctxmix._model = real
    assert all(got == want for got, want in seen) and len(seen) == 2


def test_scoring_adapts_along_a_text_and_not_to_its_mates():
    rng = np.random.default_rng(3)
    words = [b"w%d" % i for i in range(50)]
    model = small_model([b" ".join(words[i] for i in rng.integers(0, 50, 400)) for _ in range(20)])
    odd = b" ".join(words[i] for i in rng.integers(0, 2, 6000))  # other shares than in training
    alone = ctxmix.score_texts([odd], model)[0][0]
    first = ctxmix.score_texts([odd[: len(odd) // 2]], model)[0][0]
    assert alone - first > first * 0.97  # the second half is cheaper than the first
    mates = [b"w1 w2", odd, b"", b" ".join(words * 900), odd]
    got = ctxmix.score_texts(mates, model)[0]
    assert abs(got[1] - alone) < 1e-6 * abs(alone) and abs(got[4] - alone) < 1e-6 * abs(alone)


def places(text, code):
    """Per token of a text: (hash, symbol, contexts, place of its match or None, class of the match's run)."""
    toks, tails = [], []
    for w in words(text)[:-1]:
        tail = []
        toks.append(int(ctxmix.word_hashes([w], tail)[0][0]))
        tails.append(int(np.concatenate(tail)[0]))
    toks.append(int(ctxmix.END))
    syms = [int(code.symbols(np.array([t], np.uint64))[0]) for t in toks]
    rare, out, seen, run = len(code.counts) - 1, [], {}, 0
    for i, t in enumerate(toks):
        before = [j for j in range(i) if syms[j] < min(ctxmix.FREQUENT, rare)]
        two = (toks[i - 1] if i else None, toks[i - 2] if i > 1 else None)
        one, other = np.uint64(two[0] or 0), np.uint64(two[1] or 0)
        with np.errstate(over="ignore"):
            frequent, tail = np.uint64(syms[before[-1]] + 1 if before else 0), np.uint64(tails[i - 1] if i else 0)
            context = [frequent * ctxmix._A + np.uint64(1), tail * ctxmix._A + np.uint64(2), one + np.uint64(3), ctxmix.mix64(np.array([one * ctxmix._A + other]))[0] + np.uint64(4)]
            context = [ctxmix.mix64(np.array([c]))[0] for c in context]
        match = seen.get(two) if i >= 2 else None
        run = run + 1 if match is not None and out[-1][3] is not None and match == out[-1][3] + 1 else 0
        out.append((t, syms[i], context, match, 0 if match is None else 1 + (run >= 2) + (run >= 8)))
        seen[two] = i
    return out


def steps(place, code, counts, own):
    """(inputs, gate, depth, bit, keys) of every bit, with counts less the text's own."""
    path = lambda sym: [(int(code.node[code.offset[sym] + d]), int(code.bit[code.offset[sym] + d])) for d in range(code.length[sym])]
    for _, sym, context, match, run in place:
        for depth, (node, bit) in enumerate(path(sym)):
            keys = [(k, int(ctxmix.slots(np.array([c]), np.array([node], np.uint64) * ctxmix._B)[0])) for k, c in enumerate(context)]
            n = [[counts[k, b] - own[k, b] for b in (0, 1)] for k in keys]
            sure = sum(sum(n[2]) > t for t in (0, 3, 30))
            x = [float(code.order0[node]), *[math.log((b + ctxmix.SOFT) / (a + ctxmix.SOFT)) for a, b in n], 0.0, 0.3]
            if match is not None:
                guess = path(place[match][1])
                if depth < len(guess) and guess[depth][0] == node:
                    x[5], sure = 2.0 * guess[depth][1] - 1, sure + 4 * run
            yield np.array(x), sure, min(depth, ctxmix.DEPTHS - 1), bit, keys


def brute(train, score, code, vocabulary, w):
    """Scores bit by bit; of the operator only the code, the hashes and the slots."""
    counts, hits, tries = Counter(), [0] * 4, [0] * 4
    rare = len(code.counts) - 1
    of = [places(t, code) for t in train]
    own = [Counter((k, bit) for *_, bit, keys in steps(p, code, Counter(), Counter()) for k in keys) for p in of]
    for o in own:
        counts.update(o)
    slope, curve = np.zeros((ctxmix.GATES, ctxmix.INPUTS)), np.zeros((ctxmix.GATES, ctxmix.INPUTS, ctxmix.INPUTS))
    tally = np.zeros((ctxmix.DEPTHS, ctxmix.MAP_BINS, 2))
    bin_of = lambda z: int(np.rint((np.clip(z, -8, 8) + 8) * 2))
    for p, o in zip(of, own):
        for x, g, d, bit, _ in steps(p, code, counts, o):
            z = w[:, g] @ x
            q = 1 / (1 + math.exp(-z))
            slope[g] += (bit - q) * x
            curve[g] += q * (1 - q) * np.outer(x, x)
            tally[d, bin_of(z), bit] += 1
        for t, sym, _, match, run in p:
            if sym == rare and match is not None and p[match][1] == rare:
                tries[run] += 1
                hits[run] += p[match][0] == t
    w = w + np.array([np.clip(np.linalg.solve(curve[g] + ctxmix.PULL * np.eye(ctxmix.INPUTS), slope[g]), -1, 1) for g in range(ctxmix.GATES)]).T
    centre = 1 / (1 + np.exp(-np.linspace(-8, 8, ctxmix.MAP_BINS)))
    fit = np.clip((tally[..., 1] + 20 * centre) / (tally.sum(-1) + 20), 1e-4, 1 - 1e-4)
    hit = [min(max((h + 0.5) / (t + 1), 1e-3), 0.999) for h, t in zip(hits, tries)]
    rare_total = code.total - int(code.counts[:-1].sum())
    share = rare_total + code.kinds - len(code.hashes) + 1
    out = []
    for text in score:
        p, total, mine, table, seen, held = places(text, code), 0.0, w.copy(), fit.copy(), np.zeros((*fit.shape, 2)), []
        todo = list(steps(p, code, counts, Counter()))
        for i, (x, g, d, bit, _) in enumerate(todo):
            z = float(mine[:, g] @ x)
            at = (np.clip(z, -7.99, 7.99) + 8) * 2
            low = int(at)
            q = 0.5 / (1 + math.exp(-np.clip(z, -7.99, 7.99))) + 0.5 * (table[d, low] * (1 - at + low) + table[d, low + 1] * (at - low))
            total += math.log(q if bit else 1 - q)
            held.append((x, g, d, bit, z))
            if len(held) == ctxmix.STEP and i + 1 < len(todo):
                size = Counter(h[1] for h in held)
                for x, g, d, bit, z in held:
                    mine[:, g] += ctxmix.MIX_RATE / math.sqrt(size[g]) * (bit - 1 / (1 + math.exp(-z))) * x
                    seen[d, bin_of(z), bit] += 1
                n = seen.sum(-1)
                table, held = np.where(n > 0, (ctxmix.MAP_SURE * fit + seen[..., 1]) / (ctxmix.MAP_SURE + n), fit), []
        for t, sym, _, match, run in p:
            if sym == rare:
                asked = match is not None and p[match][1] == rare
                told = asked and p[match][0] == t
                total += math.log(hit[run]) if told else math.log(1 - hit[run]) if asked else 0
                total += 0 if told else math.log((vocabulary.get(t, 0) + 1) / share)
        out.append(total / math.log(10))
    return out


def test_scores_equal_brute_force_and_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(ctxmix.head_words, "__defaults__", (60,))
    rng = np.random.default_rng(8)
    names = ["w%d" % i for i in rng.zipf(1.4, 4000) % 300]
    rows = [(i, " ".join(names[40 * i : 40 * i + 40])) for i in range(24)]
    rows += [(100, " ".join(names[1000:1400] + names[1100:1300] * 2)), (101, " ".join(["w1 w2 w250"] * 120)), (102, ""), (103, None), (104, rows[3][1])]
    rows += [(200 + i, rows[5 + i][1] + " w299 neu " + rows[2][1]) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = []
    for parts in (1, 2, 7):
        dealt = docs.repartition(parts, "doc_id")
        model, vocabulary = ctxmix.learn(dealt)
        got.append({r.doc_id: r.score for r in ctxmix.score(dealt, model, vocabulary).collect()})
    assert max(abs(g[i] - got[0][i]) / max(1, abs(g[i])) for g in got for i in got[0]) < 1e-7  # single precision
    taught = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    known = {r.h % 2**64: r.c for r in vocabulary.collect()}
    want = brute(taught, [t for _, t in rows], model.code, known, ctxmix._first_weights().astype(float))
    assert len(model.code.hashes) <= 60 and min(want) < -100
    for (i, _), v in zip(rows, want):
        assert abs(got[0][i] - v) < 1e-4 * max(1, abs(v)), i


def plain(texts, code):
    s = ctxmix.read(texts, code)
    e, out = ctxmix.bits(s, code, 0, len(s.hash)), np.zeros((ctxmix.TABLES, 2 << ctxmix.TABLE_BITS), np.int64)
    for k in range(ctxmix.TABLES):
        np.add.at(out[k], 2 * e.slot[k] + e.bit, 1)
    return out


def test_small_counters_lose_nothing_where_a_half_runs_over():
    texts = [b"a b " * 70000, b"", b"c a d"]  # a path's first bit is seen more than 65535 times in one context
    code = small_model([b"a b c d a a b"]).code
    seen, small = np.zeros((ctxmix.TABLES, 2 << ctxmix.TABLE_BITS), np.int32), np.zeros((ctxmix.TABLES, 1 << ctxmix.TABLE_BITS), np.uint32)
    for _ in range(2):
        ctxmix.count_bits(texts, code, seen, small)
    ctxmix.count_bits([b"c a d"], code, seen, small)
    assert seen.max() > 2 * ctxmix.SMALL and not small.any()
    assert (seen == 2 * plain(texts, code) + plain([b"c a d"], code)).all()


def test_fit_is_the_same_by_small_counters_and_for_long_texts(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [b" ".join(b"w%d" % i for i in rng.zipf(1.5, n) % 90) for n in (3, 0, 700, 40, 2500, 1, 300)]
    code = small_model(texts).code
    n = plain(texts, code).reshape(ctxmix.TABLES, -1, 2).astype(np.float32)
    got = []
    for small, near, held in ((ctxmix.SMALL, ctxmix.NEAR_TOKENS, ctxmix.TOKENS), (ctxmix.SMALL, 50, 20000), (0, 50, 20000), (0, 50, 90)):
        monkeypatch.setattr(ctxmix, "SMALL", small or ctxmix.SMALL)
        monkeypatch.setattr(ctxmix, "NEAR_TOKENS", near)
        monkeypatch.setattr(ctxmix, "TOKENS", held)
        fit = ctxmix.Fit(code, n[..., 0], n[..., 1], ctxmix._first_weights())
        if not small:
            monkeypatch.setattr(ctxmix, "SMALL", -1)
        fit.add(texts)
        got.append(fit.sums())
        assert (fit.left == n).all()
        monkeypatch.undo()
    assert all(np.abs(g - got[0]).max() < 1e-6 for g in got)


def test_last_same_key_also_where_high_bits_are_alike():
    rng = np.random.default_rng(1)
    for key in (rng.integers(0, 40, 500), np.array([5, 4, 5, 5, 4, 6]), rng.integers(0, 9, 300) << 60, np.zeros(0, np.int64)):
        seen, want = {}, []
        for i, k in enumerate(key.tolist()):
            want.append(seen.get(k, -1))
            seen[k] = i
        assert ctxmix._last_same(key.astype(np.uint64)).tolist() == want


def test_texts_are_dealt_to_lanes_without_idle_rounds(monkeypatch):
    """A long text among short ones costs no round more than its own steps, and lanes don't change a score."""
    count = np.array([40, 1, 0, 7, 3, 3, 1, 9, 2, 2, 5, 7])
    order, lane, alive = ctxmix._lanes(count)
    assert len(alive) == 40 and alive.sum() == count.sum() and sorted(order) == list(range(count.sum()))
    text, at = np.repeat(np.arange(len(count)), count)[order], np.split(np.arange(len(order)), np.cumsum(alive)[:-1])
    assert all(lane[rows].tolist() == list(range(len(rows))) for rows in at)
    for t in range(len(count)):
        assert len(set(lane[text == t])) <= 1 and (np.diff(order[text == t]) == 1).all()
    rng = np.random.default_rng(3)
    words = [b"w%d" % i for i in range(50)]
    texts = [b" ".join(words[i] for i in rng.integers(0, 50, n)) for n in (3000, 5, 0, 400, 900, 30, 250)]
    model, rounds = small_model(texts), []
    real = ctxmix.Own.update
    monkeypatch.setattr(ctxmix.Own, "update", lambda self, *a: (rounds.append(1), real(self, *a))[1])
    got = ctxmix.score_texts(texts, model)[0]
    assert len(rounds) <= -(-int(model.code.length.max()) * 3001 // ctxmix.STEP)
    monkeypatch.setattr(ctxmix, "LANES", 1)
    assert np.allclose(ctxmix.score_texts(texts, model)[0], got, rtol=1e-7)
