import hashlib
import random

import numpy as np

from rarefold.llm import sketch


def plain(text, words=sketch.WORDS):
    w = text.lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def test_containment_of_unequal_texts_and_union():
    rng = random.Random(2)
    w = [f"w{rng.randrange(5000)}" for _ in range(20000)]
    whole, part = " ".join(w), " ".join(w[3000:4500] + [f"z{k}" for k in range(500)])
    a, b = sketch.sketches([whole.encode(), part.encode()])
    want = len(plain(whole) & plain(part)) / len(plain(part))
    assert abs(sketch.likeness(a, b) - want) < 0.1
    left, right = sketch.sketches([" ".join(w[:9000]).encode(), " ".join(w[8996:]).encode()])
    assert np.array_equal(sketch.merge(left, right), a)
    short, same = sketch.sketches([b"a b c d e f g", b"A  b\nc d e f g"])
    assert sketch.likeness(short, same) == 1 and np.array_equal(short, same)


def test_short_texts_are_held_whole():
    x, y = sketch.sketches([b"a b c d e f g h i", b"a b c d e f g x y"])
    assert len(x) == len(y) == 5 and sketch.likeness(x, y) == 3 / 5


def test_edited_texts(docs, no_docs):
    got = {(r.doc_id, r.edited_sha256): r for r in sketch.compare_edited(docs).collect()}
    base = sorted((r.doc_id, r.text or "") for r in docs.collect() if r.doc_id is not None)
    assert docs.count() == sketch.compare_edited(docs).count()
    for k, (doc_id, text) in enumerate(base):
        follow = base[(k + 1) % len(base)][1]
        m = len(text) // 4
        r = got[doc_id, hashlib.sha256((text[: len(text) - m] + follow[:m]).encode()).hexdigest()]
        assert r.n_chars == len(text) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    one = {r.doc_id: r for r in got.values()}
    assert one[1].fingerprint == one[2].fingerprint and one[1].near_next == 1 and one[1].near_edited > 0.6
    assert one[None].near_next is None
    assert sketch.compare_edited(no_docs).count() == 0
    assert sketch.compare_edited(docs.where("doc_id = 1")).first().near_next == 1


def test_small_ranges(docs, monkeypatch):
    want = sorted(map(str, sketch.compare_edited(docs).collect()))
    monkeypatch.setattr(sketch, "RANGE_ROWS", 3)
    assert sorted(map(str, sketch.compare_edited(docs).collect())) == want
