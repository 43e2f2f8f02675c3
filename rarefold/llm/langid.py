"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. A three-letter run is bound by multiplying its
letters' vectors, each rolled by its place; a text is the bundle (sum) of all its runs; a language is the
bundle of its training texts. A text goes to the language whose prototype has the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefold.llm.common import blocks, map_batches, map_stream, table

DIMENSIONS = 1024
SLOTS = 128
SEED = 20240
UNKNOWN = "und"
#: Prototypes are held by every task: more learned languages than this raise.
MAX_LANGUAGES = 2000
#: Characters taken at once, and cells of a text-by-run table.
BLOCK_CHARS, CELLS = 1 << 20, 1 << 22


def _slots() -> np.ndarray:
    """Letter slot of a code point below 65536: 0 no letter, 1-26 a-z, 27-63 Latin-1, the rest share 64-127."""
    out = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        if chr(c).isalpha():
            out[c] = c - 96 if 97 <= c <= 122 else 27 + (c - 0xDF) if 0xDF <= c <= 0xFF else 64 + c * 2654435761 % 4294967296 % 64
    return out


SLOT_OF = _slots()


def letter_vectors(dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2, (SLOTS, dimensions), dtype=np.int8) * 2 - 1


def run_vectors(runs: np.ndarray, letters: np.ndarray) -> np.ndarray:
    a, b, c = runs // SLOTS**2, runs // SLOTS % SLOTS, runs % SLOTS
    return (np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]).astype(np.float32)


def letter_runs(text: str) -> np.ndarray:
    """Codes of the three-letter runs of a text; what is no letter counts as one gap."""
    return _inner_runs(" " + text.lower() + " ")


def _inner_runs(low: str) -> np.ndarray:
    """Runs around every character but the first and the last."""
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
    slot = SLOT_OF[np.minimum(points, 0xFFFF)].astype(np.int32)
    beyond = np.flatnonzero(points > 0xFFFF)
    if len(beyond):
        slot[beyond] = [127 if chr(p).isalpha() else 0 for p in points[beyond].tolist()]
    slot = slot[(slot != 0) | np.r_[True, slot[:-1] != 0]]
    runs = (slot[:-2] * SLOTS + slot[1:-1]) * SLOTS + slot[2:]
    return runs[slot[1:-1] != 0]


def _part_runs(text: str) -> list[np.ndarray]:
    """The runs of a long text, part by part."""
    low = f" {text.lower()} "
    return [_inner_runs(low[k : k + BLOCK_CHARS + 2]) for k in range(0, max(1, len(low) - 2), BLOCK_CHARS)]


def _counts(texts: list[str], owner: np.ndarray, n: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Tables (rows, run codes, counts) of texts; a text's row may come in several tables that add up."""
    lut = np.zeros(SLOTS**3, np.int32)
    for lo, hi in blocks(texts, BLOCK_CHARS):
        parts = _part_runs(texts[lo]) if hi - lo == 1 else [letter_runs(x) for x in texts[lo:hi]]
        size = [sum(map(len, parts))] if hi - lo == 1 else list(map(len, parts))
        runs, row = np.concatenate(parts), np.repeat(owner[lo:hi], size)
        if not len(runs):
            continue
        seen = np.zeros(SLOTS**3, bool)
        seen[runs] = True
        codes = np.flatnonzero(seen)
        lut[codes] = np.arange(len(codes))
        place = lut[runs]
        first, last = int(row.min()), int(row.max()) + 1
        step = max(1, CELLS // len(codes))
        for r in range(first, last, step):
            part = slice(r, min(r + step, last))
            own = (row >= part.start) & (row < part.stop)
            cells = np.bincount((row[own] - r) * len(codes) + place[own], minlength=(part.stop - r) * len(codes))
            yield part, codes, cells.reshape(-1, len(codes)).astype(np.float32)


def profiles(docs: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Unit prototypes of the languages of (text, lang); null texts and languages teach nothing.

    Each task bundles its own texts; only (language, dimension) sums are shuffled.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, total = letter_vectors(dimensions), {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            names = sorted(set(langs))
            place = {x: i for i, x in enumerate(names)}
            order = sorted(range(len(langs)), key=lambda i: langs[i])
            owner = np.array([place[langs[i]] for i in order])
            for part, codes, cells in _counts([texts[i] for i in order], owner, len(names)):
                vectors = run_vectors(codes, letters)
                for name, v in zip(names[part], cells @ vectors, strict=True):
                    total[name] = total.get(name, 0) + v.astype(np.float64)
        for name, v in total.items():
            yield pa.RecordBatch.from_pydict({"lang": [name] * dimensions, "at": np.arange(dimensions, dtype=np.int32), "value": v})

    rows = map_stream(docs.where("text is not null and lang is not null").select("text", "lang"), learn, "lang string, at int, value double")
    rows = rows.groupBy("lang", "at").agg(F.sum("value").alias("value")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("v"))
    found = rows.select("lang", F.col("v.value").alias("v")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    out = {}
    for r in found:
        v = np.round(np.array(r.v))
        if (n := np.linalg.norm(v)) > 0:
            out[r.lang] = v / n
    return out


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, lang_pred and score (the cosine, from 0 to 1) of every row's whole text.

    A null text, one without a letter, or no learned language gives ``und`` and score 0. Equal cosines
    go to the first language by name. Repeated rows are scored alike, other columns are ignored.
    """
    names = sorted(prototypes)
    matrix = np.stack([prototypes[x] for x in names]) if names else np.zeros((0, DIMENSIONS))
    dimensions = matrix.shape[1]

    def step(batch: pa.RecordBatch) -> dict:
        letters = letter_vectors(dimensions)
        texts = [x or "" for x in batch.column("text").to_pylist()]
        total = np.zeros((len(texts), dimensions), np.float32)
        for part, codes, cells in _counts(texts, np.arange(len(texts)), len(texts)):
            total[part] += cells @ run_vectors(codes, letters)
        length = np.linalg.norm(total.astype(np.float64), axis=1)
        if not names:
            return {"lang_pred": [UNKNOWN] * len(texts), "score": np.zeros(len(texts))}
        cosine = np.round(total @ matrix.T.astype(np.float64) / np.maximum(length, 1e-300)[:, None], 12)
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best], 0, 1)
        lettered = [length[i] > 0 or len(letter_runs(t)) > 0 for i, t in enumerate(texts)]
        return {"lang_pred": [names[b] if k else UNKNOWN for b, k in zip(best, lettered, strict=True)], "score": np.where(lettered, score, 0.0)}

    return map_batches(docs.select(*dict.fromkeys((*carry, "text"))), step, "lang_pred string, score double", carry)


def held_out(doc_id: str, mod: int, rest: int):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % mod == rest, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows that are not held out.

    A null doc_id is neither held out nor learned from.
    """
    taught = docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    out = identify(docs.select("doc_id", "text"), profiles(taught))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


def op2_langid(spark, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))
