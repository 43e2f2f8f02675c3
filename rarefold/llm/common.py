"""Helpers shared by the training-data operators: byte blocks, word hashes, checkpoints, components."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rarefold.session import ensure_checkpoint_dir

#: Text bytes handled by one vectorised step inside a task; bounds a task's memory.
BLOCK_BYTES = 1 << 20

#: Rows handed to a step at once, and bytes of an Arrow batch where the session names none: what a Python worker holds doesn't grow with the texts.
STEP_ROWS, BATCH_BYTES = 1024, 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

#: The white space of the token rule ``[^\x20\x09-\x0D]+``.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_STEP = 0x9E3779B97F4A7C15 | 1
_STEP_INVERSE = pow(_STEP, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers (as ``--py-files`` does) unless their path has it already."""
    root, sc = Path(__file__).resolve().parents[2], spark.sparkContext
    seen = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if sc.master == "local" or sc.master.startswith("local["):
        seen.append(os.getcwd())  # workers start in the driver's folder
    if getattr(sc, "_rarefold_sent", False) or any(x and Path(x).resolve() == root for x in seen):
        return
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "rarefold"), "zip", root, "rarefold")
    sc.addPyFile(made)
    sc._rarefold_sent = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder in spark.checkpoint.dir: no lineage, survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def map_stream(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    spark = df.sparkSession
    ship(spark)
    if not spark.sparkContext.getConf().contains(_BATCH_CONF):
        spark.conf.set(_BATCH_CONF, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, step: Callable[[pa.RecordBatch], dict], schema: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``step`` turns an Arrow batch into columns named as in ``schema``; empty batches are skipped.

    Columns named in ``carry`` come first, with the types they have in ``df``.
    """
    schema = StructType([*(df.schema[c] for c in carry), *StructType.fromDDL(schema)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, STEP_ROWS):
                batch = whole.slice(lo, STEP_ROWS)
                out = step(batch) | {c: batch.column(c) for c in carry}
                yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return map_stream(df, run, schema)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text; a null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``limit`` bytes; a longer text is a range of its own."""
    lo = size = 0
    for i, text in enumerate(texts):
        if i > lo and size + len(text) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(text)
    if lo < len(texts):
        yield lo, len(texts)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        n = max(n, BLOCK_BYTES + (BLOCK_BYTES >> 1))
        for name, base in (("up", _STEP), ("down", _STEP_INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _pieces(text: bytes) -> Iterator[bytes]:
    """A very long text in pieces that end between words, so that memory stays bounded."""
    lo = 0
    while len(text) - lo > BLOCK_BYTES:
        hi = lo + BLOCK_BYTES
        while hi < len(text) and not IS_SPACE[text[hi]]:
            hi += 1
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


def word_spans(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, word starts and word ends of a buffer that begins and ends with white space."""
    buf = np.frombuffer(joined, np.uint8)
    space = IS_SPACE[buf]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    return buf, edges[::2], edges[1::2]


def word_hashes(texts: list[bytes], ends: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts in order, and each text's range of them.

    A prefix-sum polynomial hash: one multiply and one add a byte, whatever the words. ``ends`` gets arrays
    of the words' last two bytes (the one before a one-byte word is white space).
    """
    out, counts = [], np.zeros(len(texts) + 1, np.int64)
    for lo, hi in blocks(texts):
        groups = [texts[lo:hi]] if hi - lo > 1 or len(texts[lo]) <= BLOCK_BYTES else [[x] for x in _pieces(texts[lo])]
        for group in groups:
            joined = b" " + b"\n".join(group) + b" "
            buf, s, e = word_spans(joined)
            up, down = _power(len(buf))
            total = np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], dtype=np.uint64)
            h = (total[e - 1] - total[s - 1]) * down[s]
            out.append(mix64(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
            if ends is not None:
                ends.append(buf[e - 1].astype(np.int64) << 8 | buf[e - 2])
            stops = np.cumsum([len(x) + 1 for x in group])
            per = np.diff(np.searchsorted(s, stops + 1), prepend=0)
            counts[lo + 1 : lo + 1 + len(group)] += per if hi - lo > 1 else [per.sum()]
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(counts)


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of the long pairs (u, v): rows (node, root), root the smallest node reachable.

    Alternating large and small stars: every round is two grouped minima and two joins, written to
    the shared folder; stars shrink geometrically, no component is ever gathered in one task. Raises if
    ``max_rounds`` rounds, far over the logarithm of any node count, do not settle it.
    """
    e = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = checkpointed(small.where("u <> v").distinct())
        now = e.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.sum(F.expr("pmod(xxhash64(v, u), 1000003)")).alias("s")).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
