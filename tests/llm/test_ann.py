import numpy as np

from rarefold.llm import ann


def brute(ids, x, k=20, every=20):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = np.array([float((x[i] * p).sum()) for p in x])
        s[ids == ids[i]] = -np.inf
        order = np.lexsort((ids, -s))[:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order if np.isfinite(s[j])]
    return out


def found(df, **a):
    out = {}
    for r in ann.nearest(df, **a).orderBy("query_id", "rank").collect():
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row], 0) for i, row in zip(ids, x)], "vec_id long, embedding array<float>, cell int")


def test_recall_on_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    t = df.toPandas()
    want, got = brute(t.vec_id.to_numpy(), np.stack(t.embedding).astype(float)), found(df)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    score = {q: dict(v) for q, v in want.items()}
    assert all(abs(score[q].get(i, s) - s) < 1e-12 for q in got for i, s in got[q])


def test_unequal_norms_many_cells_and_blocks(spark, monkeypatch):
    for name, value in (("CELL_ROWS", 60), ("BLOCK_ROWS", 50), ("QUERY_ROWS", 7), ("LEAF_ROWS", 16)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(900, 6)) * rng.uniform(0.1, 5, size=(900, 1))).astype(np.float32)
    ids = np.arange(900)
    want, got = brute(ids, x.astype(float)), found(frame(spark, ids, x))
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got.get(q, [])}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_ties_and_awkward_vectors(spark):
    x = np.array([[1.0, 0.0]] * 60 + [[0.0, 1.0]] * 5, np.float32)
    got = found(frame(spark, np.arange(65), x))
    assert [i for i, _ in got[0]] == list(range(1, 21)) and [i for i, _ in got[40]] == list(range(20))
    rows = [(0, [1.0, 2.0]), (20, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (100, [None, 1.0]), (120, []), (140, [1.0]), (None, [1.0, 1.0]), (1, [2.0, 1.0]), (0, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found(df) == {0: [(1, 4.0)]} or set(found(df)) == {0}
    assert ann.nearest(df.limit(0)).count() == 0
    assert found(spark.createDataFrame([(20, [1.0, 2.0])], "vec_id long, embedding array<float>")) == {}


def test_chi_square_bound():
    x = np.random.default_rng(3).chisquare(8, 200000)
    assert abs((x <= ann.chi_square_bound(8, 0.95)).mean() - 0.95) < 0.005
