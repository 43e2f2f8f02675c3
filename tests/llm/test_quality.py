import numpy as np

from rarefold.llm import quality


def test_linear_time_score_equals_pairwise_sum():
    rng = np.random.default_rng(0)
    index, value, at = quality.features([b"one two two THREE!!", b"", b"a | b | c"])
    m = quality.Machine(0.3, rng.normal(size=quality.FEATURES), rng.normal(size=(quality.FEATURES, 3)))
    got = m.margin(index, value, at)
    for k in range(3):
        i, x = index[at[k] : at[k + 1]], value[at[k] : at[k + 1]]
        want = 0.3 + sum(m.w[a] * b for a, b in zip(i, x))
        want += sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a + 1, len(i)))
        assert abs(want - got[k]) < 1e-9


def test_learns_from_training_labels_only(spark, docs, no_docs):
    import awkward

    rows = [(k, awkward.prose(k, 60) if k % 3 else " | ".join(["junk!!"] * 30), None, None, 0) for k in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(300)], "doc_id long, quality int, toxic int")
    out = quality.quality(d, labels).collect()
    held = [r for r in out if r.held_out]
    assert held and sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.95 * len(held)
    assert all(r.predicted == int(r.score >= 0.3) for r in out)
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    none = labels.limit(0)
    assert {r.score for r in quality.quality(docs, none).collect()} == {0.5}
    assert quality.quality(no_docs, labels).count() == 0
