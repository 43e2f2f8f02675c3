"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + <w, x> + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]), linear in the number of
features. Features are made in the tasks over whole texts; the machine is fitted on a sample of labelled
rows of at most ``TRAIN_ROWS`` documents (half a class each, the smallest hashes of doc_id), the only bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefold.llm.common import blocks, map_batches, table, texts_of, word_hashes
from rarefold.llm.langid import held_out

TRAIN_ROWS = 6000
WORD_BITS = 15
BINS = 16
#: (name, low, high): a statistic falls into one of BINS equal parts of [low, high].
STATISTICS = (
    ("upper", 0, 0.6), ("digit", 0, 0.5), ("punctuation", 0, 0.5), ("space", 0, 0.4), ("line", 0, 0.1), ("not_ascii", 0, 0.5),
    ("pipe", 0, 0.1), ("marks", 0, 0.3), ("word_length", 0, 20), ("distinct", 0, 1), ("top_word", 0, 0.4), ("log_words", 0, 16), ("log_chars", 0, 20),
)
FEATURES = (1 << WORD_BITS) + len(STATISTICS) * BINS
RANK = 8
THRESHOLD = 0.3
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.1, 1e-5


def _class_table() -> np.ndarray:
    out = np.zeros((256, 9), np.uint8)  # upper, digit, punctuation, space, line, not ascii, pipe, marks, code point
    for c in range(256):
        x = chr(c) if c < 128 else ""
        out[c] = [x.isupper(), x.isdigit(), x != "" and 32 < c < 127 and not x.isalnum(), c == 32, c == 10, c > 127, x == "|", x != "" and x in "!#$%&*<>@=~^_", not 128 <= c < 192]
    return out


CLASSES = _class_table()


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and values of all texts in order, and each text's range of them."""
    index, value, size = [], [], []
    for lo, hi in blocks(texts):
        group = texts[lo:hi]
        n = hi - lo
        counts = np.zeros((n, 9))
        length = np.array([len(x) for x in group])
        for k, text in enumerate(group):
            counts[k] = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ CLASSES
        h, at = word_hashes([x.lower() for x in group])
        words = np.diff(at)
        key = (np.repeat(np.arange(n), words) << WORD_BITS) | (h & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
        key, tf = np.unique(key, return_counts=True)
        owner = key >> WORD_BITS
        distinct = np.bincount(owner, minlength=n)
        top = np.zeros(n)
        np.maximum.at(top, owner, tf)
        x = 1 + np.log(tf)
        x /= np.sqrt(np.bincount(owner, x * x, n))[owner]
        per, some = np.maximum(length, 1), np.maximum(words, 1)
        stats = np.column_stack([*(counts[:, k] / per for k in range(8)), length / some, distinct / some, top / some, np.log2(1 + words), np.log2(1 + counts[:, 8])])
        low, high = (np.array([s[k] for s in STATISTICS], float) for k in (1, 2))
        part = np.clip((stats - low) / (high - low) * BINS, 0, BINS - 1).astype(np.int64)
        part += (1 << WORD_BITS) + BINS * np.arange(len(STATISTICS))
        owner = np.r_[owner, np.repeat(np.arange(n), len(STATISTICS))]
        order = np.argsort(owner, kind="stable")
        index.append(np.r_[key & ((1 << WORD_BITS) - 1), part.ravel()][order])
        value.append(np.r_[x, np.full(part.size, 0.5)][order])
        size.append(distinct + len(STATISTICS))
    if not index:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(1, np.int64)
    return np.concatenate(index), np.concatenate(value), np.r_[0, np.cumsum(np.concatenate(size))]


class Machine:
    """w0, w and V of a factorisation machine."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def margin(self, index: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Every text has features (its statistics at least), so each range is not empty."""
        xv = self.v[index] * value[:, None]
        s = np.add.reduceat(xv, at[:-1], axis=0)
        q = np.add.reduceat((xv * xv).sum(1), at[:-1])
        return self.w0 + np.add.reduceat(self.w[index] * value, at[:-1]) + 0.5 * ((s * s).sum(1) - q)


def fit(index: np.ndarray, value: np.ndarray, at: np.ndarray, label: np.ndarray) -> Machine:
    """Adaptive-step gradient descent on the log loss, both classes weighing alike; fixed order, no state kept."""
    rng = np.random.default_rng(7)
    m = Machine(0.0, np.zeros(FEATURES), rng.normal(0, 0.01, (FEATURES, RANK)))
    if len(label) == 0 or label.min() == label.max():
        m.w0, m.v = (0.0 if len(label) == 0 else 6.0 if label[0] else -6.0), np.zeros_like(m.v)
        return m
    weight = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean()))
    g0, gw, gv = 1e-8, np.full(FEATURES, 1e-8), np.full((FEATURES, RANK), 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for b in range(0, len(order), BATCH):
            rows = order[b : b + BATCH]
            size = at[rows + 1] - at[rows]
            start = np.r_[0, np.cumsum(size)]
            take = np.arange(start[-1]) - np.repeat(start[:-1], size) + np.repeat(at[rows], size)
            i, x = index[take], value[take]
            p = 1 / (1 + np.exp(-np.clip(m.margin(i, x, start), -30, 30)))
            d = (p - label[rows]) * weight[rows] / len(rows)
            dx = np.repeat(d, size) * x
            xv = m.v[i] * x[:, None]
            s = np.add.reduceat(xv, start[:-1], axis=0)
            feats, place = np.unique(i, return_inverse=True)
            dw = np.bincount(place, dx, len(feats)) + DECAY * m.w[feats]
            each = dx[:, None] * (np.repeat(s, size, axis=0) - xv)
            dv = np.column_stack([np.bincount(place, each[:, k], len(feats)) for k in range(RANK)]) + DECAY * m.v[feats]
            g0 += d.sum() ** 2
            gw[feats] += dw * dw
            gv[feats] += dv * dv
            m.w0 -= RATE * d.sum() / np.sqrt(g0)
            m.w[feats] -= RATE * dw / np.sqrt(gw[feats])
            m.v[feats] -= RATE * dv / np.sqrt(gv[feats])
    return m


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Fit on labelled documents that are not held out. Conflicting labels of a document: the majority, ties 1."""
    known = labels.where("doc_id is not null and quality in (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    known = known.groupBy(F.col("doc_id").alias("key")).agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    ids = docs.select(F.col("doc_id").alias("key")).distinct()
    known = known.join(ids, "key", "left_semi")
    pick = None
    for q in (0, 1):
        part = known.where(F.col("quality") == q).orderBy(F.xxhash64("key"), "key").limit(rows // 2)
        pick = part if pick is None else pick.union(part)
    mine = docs.select("doc_id", "text").join(F.broadcast(pick), F.col("doc_id") == F.col("key")).select("doc_id", "text", "quality")

    def step(batch: pa.RecordBatch) -> dict:
        index, value, at = features(texts_of(batch.column("text")))
        return {
            "doc_id": batch.column("doc_id"), "quality": batch.column("quality"),
            "i": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(index, pa.int32())),
            "x": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(value, pa.float32())),
        }

    # a repeated doc_id gives several rows: sorted by content, so that the fit doesn't depend on tasks
    got = map_batches(mine, step, "doc_id long, quality int, i array<int>, x array<float>").orderBy("doc_id", F.xxhash64("i")).limit(2 * rows).toArrow()
    i, x = got.column("i").combine_chunks(), got.column("x").combine_chunks()
    size = np.array([len(r) for r in i], np.int64)
    return fit(i.flatten().to_numpy().astype(np.int64), x.flatten().to_numpy().astype(np.float64), np.r_[0, np.cumsum(size)], got.column("quality").to_numpy().astype(float))


def score(docs: DataFrame, machine: Machine, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, score and predicted of every row. A null text is scored as an empty one.

    Repeated rows score alike; extra columns are ignored; with no labels every score is 0.5, with one class only it is that class's.
    """
    w0, w, v = machine.w0, machine.w.astype(np.float32), machine.v.astype(np.float32)
    sent = docs.sparkSession.sparkContext.broadcast((w0, w, v))  # FEATURES x (RANK + 1) numbers, whatever the data

    def step(batch: pa.RecordBatch) -> dict:
        m, texts = Machine(*sent.value), texts_of(batch.column("text"))
        p = np.concatenate([1 / (1 + np.exp(-np.clip(m.margin(*features(texts[lo:hi])), -30, 30).astype(float))) for lo, hi in blocks(texts)])
        p = np.round(p, 6)
        return {"score": p, "predicted": (p >= THRESHOLD).astype(np.int32)}

    return map_batches(docs.select(*dict.fromkeys((*carry, "text"))), step, "score double, predicted int", carry)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
