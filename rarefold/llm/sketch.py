"""Document fingerprints: threshold-scaled sketches.

A sketch holds every hash below a fixed fraction of the hash range, over the text's five-word shingles, and
at least its LEAST smallest ones, so that short texts are held whole. Sketches of parts unite to the sketch
of the whole, and |A & B| / min(|A|, |B|) below the common threshold estimates containment whatever the
two lengths.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefold.llm.common import map_batches, map_stream, mix64, table, texts_of, word_hashes

WORDS = 5
#: One hash in FRACTION is kept; a fingerprint writes its first DIGITS hexadecimal digits.
FRACTION = 8
LEAST = 32
DIGITS = 12
LIMIT = (1 << 4 * DIGITS) // FRACTION
#: Rows of one range of doc_ids, and most ranges (their first ids are held by every task).
RANGE_ROWS, MAX_RANGES = 1000, 100_000
#: Characters compared at once.
ROWS_CHARS = 4 << 20


def _shingles(h: np.ndarray, words: int) -> np.ndarray:
    """Hashes of ``words`` neighbouring words; of all words, if fewer."""
    n = max(len(h) - words + 1, min(len(h), 1))
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        out = (out ^ h[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return mix64(out)


def _kept(h: np.ndarray) -> np.ndarray:
    return h[: max(LEAST, int(np.searchsorted(h, np.uint64(LIMIT))))]


def sketches(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct kept hashes of every text; empty only for a text without a word."""
    h, at = word_hashes([x.lower() for x in texts])
    out = []
    for a, b in pairwise(at.tolist()):
        own = _shingles(h[a:b], words) >> np.uint64(64 - 4 * DIGITS)
        low = own[own < LIMIT]
        low = np.unique(low)
        out.append(low if len(low) >= LEAST else _kept(np.unique(own)))
    return out


def threshold(s: np.ndarray) -> int:
    """Every hash of the text below this is in its sketch."""
    return 1 << 4 * DIGITS if len(s) < LEAST else max(LIMIT, int(s[LEAST - 1]) + 1)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of two shingle sets."""
    h = np.union1d(a, b)
    return _kept(h[h < min(threshold(a), threshold(b))])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Containment of the smaller in the larger, 0 to 1; two empty sketches are alike, an empty and a full one not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = np.uint64(min(threshold(a), threshold(b)))
    a, b = a[a < common], b[b < common]
    return len(np.intersect1d(a, b, assume_unique=True)) / max(1, min(len(a), len(b)))


def written(s: np.ndarray) -> str:
    """A sketch as text: its hashes in ascending order, DIGITS hexadecimal digits each."""
    raw = s.astype(">u8").tobytes().hex()
    return "".join([raw[k + 16 - DIGITS : k + 16] for k in range(0, len(raw), 16)])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row: the sketch of its whole text; a null text is an empty one."""

    def step(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "fingerprint": list(map(written, sketches(texts_of(batch.column("text")))))}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), step, "doc_id long, fingerprint string")


def in_ranges(docs: DataFrame) -> DataFrame:
    """(part, extra, doc_id, text): doc_id ranges, each followed by the first row of the next range as ``extra``.

    One shuffle of the texts: the ranges come from the ids alone, and the rows of a range's smallest id also
    go to the range before (the first range's to the last). Rows without doc_id are dealt by their hash.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = docs.select("doc_id").where("doc_id is not null")
    n = ids.count()
    k = min(MAX_RANGES, n // RANGE_ROWS + 1)
    cuts = sorted(set(ids.approxQuantile("doc_id", [i / k for i in range(1, k)], 1 / (4 * k)))) if k > 1 else []
    cuts = cuts or [0.0]
    deal = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="place", outputCol="part")

    def ranged(df: DataFrame) -> DataFrame:
        return deal.transform(df.withColumn("place", F.col("doc_id").cast("double"))).drop("place").withColumn("part", F.col("part").cast("int"))

    least = ranged(ids).groupBy("part").agg(F.min("doc_id").alias("doc_id"))
    found = sorted((r.part, r.doc_id) for r in least.collect())  # at most MAX_RANGES rows
    before = [(doc_id, found[i - 1][0], True) for i, (_, doc_id) in enumerate(found)]
    first = docs.sparkSession.createDataFrame(before, "doc_id long, part int, extra boolean")
    own = ranged(docs.where("doc_id is not null")).withColumn("extra", F.lit(False))
    unnamed = docs.where("doc_id is null").withColumn("part", F.pmod(F.xxhash64("text"), F.lit(k)).cast("int")).withColumn("extra", F.lit(False))
    columns = ("part", "extra", "doc_id", "text")
    return own.select(*columns).unionByName(docs.join(F.broadcast(first), "doc_id").select(*columns)).unionByName(unnamed.select(*columns))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # the last row, whose next document is not known yet: part, doc_id, text
    for batch in batches:
        ready: list[tuple[int | None, str, str | None]] = []
        for part, extra, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "extra", "doc_id", "text")), strict=True):
            if doc_id is None:
                ready.append((None, text, None))
                continue
            if held and held[0] == part:
                ready.append((held[1], held[2], text))
            held = None if extra else (part, doc_id, text)
        if ready:
            yield from _digest(ready)


def _digest(rows: list[tuple[int | None, str, str | None]]) -> Iterator[pa.RecordBatch]:
    sizes = [3 * len(t) + len(x or "") for _, t, x in rows]
    lo = total = 0
    for hi in range(1, len(rows) + 1):
        total += sizes[hi - 1]
        if total > ROWS_CHARS or hi == len(rows):
            part = rows[lo:hi]
            own = [t.encode("utf-8", "replace") for _, t, _ in part]
            edited = [(t if x is None else t[: len(t) - len(t) // 4] + x[: len(t) // 4]).encode("utf-8", "replace") for _, t, x in part]
            a, b = sketches(own), sketches(edited)
            follows = [i + 1 < len(part) and part[i + 1][1] is r[2] for i, r in enumerate(part)]  # the next row's own sketch serves
            other = iter(sketches([(r[2] or "").encode("utf-8", "replace") for r, f in zip(part, follows, strict=True) if not f]))
            c = [a[i + 1] if f else next(other) for i, f in enumerate(follows)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([r[0] for r in part], pa.int64()),
                "n_chars": pa.array([len(r[1]) for r in part], pa.int64()),
                "edited_sha256": [hashlib.sha256(x).hexdigest() for x in edited],
                "fingerprint": list(map(written, a)),
                "edited_fingerprint": list(map(written, b)),
                "near_edited": pa.array(map(likeness, a, b), pa.float64()),
                "near_next": pa.array([None if r[2] is None else likeness(x, y) for r, x, y in zip(part, a, c, strict=True)], pa.float64()),
            })
            lo, total = hi, 0


def compare_edited(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The next document is the next row by doc_id, equal ids by text; after the last comes the first. A row
    without doc_id stands outside that order: its edited text is its own, near_next is null. A null text is
    an empty one; two texts without words are alike. An empty table gives no rows; extra columns are ignored.
    """
    rows = in_ranges(docs).repartition("part").sortWithinPartitions("part", "extra", "doc_id", "text")
    return map_stream(rows, _compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))
