"""Exact running sums at any scale: the kernel behind ranks, AUC, AP, curves and folds.

A plain ``Window.partitionBy(g).orderBy(v)`` puts every row of a group into one
task; with a two-valued label or a handful of attributes that is a handful of
giant tasks.  The kernel splits the order into a data-independent, monotone
coarse key (the *bucket*):

1. totals per (group, bucket)            -- partial aggregation, tiny result
2. exclusive prefix over bucket totals   -- window over <= buckets rows per group
3. fine exclusive prefix inside (group, bucket), plus the bucket offset

Step 3 is partitioned by (group, bucket), so a group's rows spread over many
tasks.  The answer equals the single-window answer exactly.

``exclusive_prefix`` takes the bucket from its caller, ``hash_rank`` that of an md5 (evenly spread whatever the data).  ``value_prefix``
orders by values, whose spread only the data know: there the splitters are those of a range partitioning, which Spark samples.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rarefold.functions.cache import keep, release  # noqa: F401  (release re-exported)
from rarefold.session import scratch_path

_MANTISSA_STEPS = 1024
_OFFSET = 1 << 22


def float_bucket(c: Column) -> Column:
    """Monotone coarse key of a double: sign, binary exponent and 10 mantissa bits.

    ``floor(|v| * 1024 / 2^e) + (e - 1) * 1024`` is continuous across a
    mis-rounded ``floor(log2(|v|))`` so it stays monotone; negatives mirror.
    At most ~4M distinct keys whatever the data volume; infinities take the two ends.
    """
    a = F.abs(c)
    e = F.floor(F.log2(a))
    k = F.floor(a / F.pow(F.lit(2.0), e) * _MANTISSA_STEPS) + (e - 1) * _MANTISSA_STEPS + _OFFSET
    end = F.lit(float("inf"))
    k = F.when(a == end, F.lit(1 << 40)).otherwise(F.when(a < end, k))
    return F.when(c > 0, k).when(c < 0, -k).otherwise(F.lit(0)).cast("long")


def hex_bucket(c: Column, digits: int = 4) -> Column:
    """Monotone coarse key of a lowercase hex string (e.g. an md5)."""
    return F.conv(F.substring(c, 1, digits), 16, 10).cast("long")


def exclusive_prefix(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    sums: Sequence[str],
    descending: bool = False,
    suffix: str = "_before",
) -> DataFrame:
    """Add ``<c><suffix>`` = sum of ``c`` over rows of the same ``part`` strictly earlier in ``order``.

    ``bucket`` must be monotone (non-decreasing) in ``order``; ``order`` must be
    unique within ``part`` (pre-aggregate ties first).
    """
    part = list(part)
    # The input is read twice (bucket totals, fine window), and the result is typically read
    # by several downstream branches.  A plan is a tree, so without a shared materialisation
    # chained kernels would re-run their upstream 2^d times.  The kernel's OUTPUT is persisted
    # (memory, spilling to disk; a lost block is recomputed deterministically from lineage):
    # each kernel then runs once and a chain costs linear work.
    tagged = df.withColumn("_bkt", bucket).repartition(*part, "_bkt")
    totals = tagged.groupBy(*part, "_bkt").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    bo = F.col("_bkt").desc() if descending else F.col("_bkt").asc()
    wb = Window.partitionBy(*part).orderBy(bo).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *part, "_bkt", *[F.coalesce(F.sum(f"_t_{c}").over(wb), F.lit(0)).alias(f"_o_{c}") for c in sums]
    )
    joined = tagged.join(offsets, on=[*part, "_bkt"], how="inner")
    oc = [F.col(o).desc() if descending else F.col(o).asc() for o in order]
    wf = Window.partitionBy(*part, "_bkt").orderBy(*oc).rowsBetween(Window.unboundedPreceding, -1)
    out = joined
    for c in sums:
        out = out.withColumn(f"{c}{suffix}", F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(wf), F.lit(0)))
    return keep(out.drop("_bkt", *[f"_o_{c}" for c in sums]))


#: Leading hex digits of a hash that make its bucket in ``hash_rank``: 4096 buckets a part.
HASH_DIGITS = 3


def hash_rank(df: DataFrame, part: Sequence[str], h: Column, sums: Sequence[str] = (), out: str = "rank0", suffix: str = "_before") -> DataFrame:
    """Add ``out``, the 0-based place of each row inside ``part`` by the md5 ``h``, and for each of ``sums`` what its earlier rows add up to.

    ``h`` must be the md5 of a row's whole key, so that rows of equal hash have equal keys; rows with a null in ``part`` take no part.
    Hashes are spread evenly: the rows of each leading piece are counted first (map-side; 4096 rows a part, broadcast), then one shuffle
    brings every piece together. Nothing is stored, so only the columns that a query reads on are shuffled, and the hash travels as
    16 bytes. Whoever reads the result more than once keeps the columns it needs.
    """
    part, sums = list(part), list(sums)
    x = df.withColumn("_md5", h)
    x = x.withColumns({"_bkt": F.conv(F.substring("_md5", 1, HASH_DIGITS), 16, 10).cast("int"), "_h": F.unhex("_md5")}).drop("_md5")
    totals = x.groupBy(*part, "_bkt").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_t_{c}") for c in sums])
    earlier = Window.partitionBy(*part).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    below = {"_o": "_n"} | {f"_o_{c}": f"_t_{c}" for c in sums}
    offsets = totals.select(*part, "_bkt", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(o) for o, c in below.items()])
    inside = Window.partitionBy(*part, "_bkt").orderBy("_h")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # sums up to and with the row, less the row itself: such a frame needs no look back
    own = {out: F.row_number().over(inside) - 1} | {f"{c}{suffix}": F.sum(c).over(running) - F.col(c) for c in sums}
    ranked = x.withColumns(own).join(F.broadcast(offsets), [*part, "_bkt"])
    done = {out: (F.col(out) + F.col("_o")).cast("long")} | {f"{c}{suffix}": F.col(f"{c}{suffix}") + F.col(f"_o_{c}") for c in sums}
    return ranked.withColumns(done).drop("_bkt", "_h", *below)


def value_prefix(df: DataFrame, part: Sequence[str], value: str, sums: Sequence[str], descending: bool = False, suffix: str = "_before") -> DataFrame:
    """Add ``<c><suffix>`` = sum of ``c`` over rows of the same ``part`` with a strictly earlier ``value`` (unique within ``part``).

    Rows are dealt by range of (part, value): equally many a task, however narrow or crowded the values are. A task adds up its
    own rows in order; what lies in earlier tasks is one row for each group and task that holds some of it (a range is contiguous,
    so fewer than groups + tasks), which is broadcast. Groups are cells, attributes or replicates, never data.
    """
    part = list(part)
    keys = [F.col(value).desc() if descending else F.col(value).asc()]
    floats = {c: isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) for c in sums}
    types = {c: T.DoubleType() if floats[c] else T.LongType() for c in sums}
    schema = T.StructType([*df.schema.fields, *[T.StructField(f"{c}{suffix}", types[c]) for c in sums], T.StructField("_task", T.IntegerType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, carry = TaskContext.get().partitionId(), None, {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for c in part:
                x = batch.column(c).to_numpy(zero_copy_only=False)
                new[1:] |= x[1:] != x[:-1]
            head = tuple(batch.column(c)[0].as_py() for c in part)
            goes_on = last is not None and head == last
            new[0] = True
            start, run_of = np.flatnonzero(new), np.cumsum(new) - 1
            before = []
            for c in sums:
                x = np.nan_to_num(batch.column(c).to_numpy(zero_copy_only=False).astype(float)) if floats[c] or batch.column(c).null_count else batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(x)
                out = total - x - (total[start] - x[start])[run_of]
                if goes_on:
                    out[run_of == 0] += carry[c]
                carry[c] = out[-1] + x[-1]
                before.append(pa.array(out if floats[c] else out.astype(np.int64)))
            last = tuple(batch.column(c)[n - 1].as_py() for c in part)
            yield pa.RecordBatch.from_arrays([*batch.columns, *before, pa.array(np.full(n, task, np.int32))], names=names)

    dealt = df.repartitionByRange(*part, *keys).sortWithinPartitions(*part, *keys)
    # written to the shared folder once: another evaluation could draw other splitters, and the rows are read twice. A checkpoint
    # would run the tasks twice and store whole rows; files by column are compressed, and readers take the columns they need
    at = scratch_path(df.sparkSession, f"prefix-{uuid.uuid4().hex}")
    dealt.mapInArrow(run, schema).write.parquet(at)
    inside = df.sparkSession.read.schema(schema).parquet(at)
    totals = inside.groupBy(*part, "_task").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    earlier = Window.partitionBy(*part).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*part, "_task", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums])
    out = inside.join(F.broadcast(offsets), [*part, "_task"])
    done = {f"{c}{suffix}": F.col(f"{c}{suffix}") + F.col(f"_o_{c}") for c in sums}
    return out.withColumns(done).drop("_task", *[f"_o_{c}" for c in sums])
