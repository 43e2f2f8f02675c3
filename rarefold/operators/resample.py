"""F: stratified, seeded, reproducible splits and resampling -- all map-side or prefix-kernel.

Row order inside a class is ``md5(seed|rep|key)``: deterministic across engines
and re-executions (an executor lost mid-job recomputes the same folds).  The
rank inside a class uses the two-level prefix kernel keyed by the md5 prefix,
so a two-valued label never becomes two giant window tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rarefold.functions.columns import md5_uniform
from rarefold.functions.md5 import Tails
from rarefold.functions.partitioning import spread
from rarefold.functions.ranks import hash_rank

# Learning-curve train fractions (numpy.linspace(0.25, 0.85, 6)).
LEARNING_FRACTIONS = (0.25, 0.37, 0.49, 0.61, 0.73, 0.85)


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def rank_in_class(df: DataFrame, part: list[str], h: Column, out: str = "rank0") -> DataFrame:
    """0-based position of each row inside ``part`` ordered by its md5 ``h``. Not stored: select what is needed before a second reading."""
    return hash_rank(df, part, h, out=out)


def stratified_folds(df: DataFrame, label: str, k: int = 5, seed: int = 42, rep: int | Column = 0, key: str = "row_id", keep_rank: bool = False) -> DataFrame:
    """add ``fold`` in [0, k): rank inside the class (``rank0``) by md5(seed|rep|key), modulo k."""
    rep_c = rep if isinstance(rep, Column) else F.lit(rep)
    x = df.withColumn("rep", rep_c.cast("int"))
    r = rank_in_class(x, ["rep", label], _hash(F.lit(seed), F.col("rep"), F.col(key)))
    r = r.withColumn("fold", F.pmod(F.col("rank0"), F.lit(k)).cast("int"))
    return r if keep_rank else r.drop("rank0")


def repeated_folds(df: DataFrame, label: str, k: int = 5, repeats: int = 10, seed: int = 42, key: str = "row_id") -> DataFrame:
    """R independent stratified k-fold assignments (rows x R, generated lazily)."""
    x = spread(df, key).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    r = rank_in_class(x, ["rep", label], _hash(F.lit(seed), F.col("rep"), F.col(key)))
    return r.withColumn("fold", F.pmod(F.col("rank0"), F.lit(k)).cast("int")).drop("rank0")


def fold_expansion(folded: DataFrame, k: int) -> DataFrame:
    """each row once per outer fold: role 'test' in its own fold, 'train' in the k-1 others.

    The k-row fold table is broadcast; downstream aggregations combine map-side,
    so the k copies are never shuffled.
    """
    spark = folded.sparkSession
    outer = F.broadcast(spark.range(k).select(F.col("id").cast("int").alias("outer")))
    # rows come dealt by their hash; asking for their number of partitions would run the job that ranked them
    return folded.crossJoin(outer).withColumn(
        "role", F.when(F.col("fold") == F.col("outer"), F.lit("test")).otherwise(F.lit("train"))
    )


def nested_folds(folded: DataFrame, label: str, k_outer: int, k_inner: int = 3, seed: int = 42, key: str = "row_id") -> DataFrame:
    """inner stratified folds inside each outer training part: (rep, outer, key, inner)."""
    train = fold_expansion(folded, k_outer).filter(F.col("role") == "train")
    h = _hash(F.lit(seed), F.lit("inner"), F.col("rep"), F.col("outer"), F.col(key))
    r = rank_in_class(train, ["rep", "outer", label], h)
    return r.withColumn("inner", F.pmod(F.col("rank0"), F.lit(k_inner)).cast("int")).drop("rank0", "role")


def stratified_holdout(df: DataFrame, label: str, train_tenths: int = 7, seed: int = 42, key: str = "row_id") -> DataFrame:
    """exact stratified 70/30 split: first floor(0.7 n_c) rows of each class (md5 order) train."""
    r = rank_in_class(df, [label], _hash(F.lit(seed), F.lit("holdout"), F.col(key)))
    n_c = r.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    j = r.join(F.broadcast(n_c), label)
    cut = F.floor(F.col("n_c") * train_tenths / 10)
    return j.withColumn("split", F.when(F.col("rank0") < cut, F.lit("train")).otherwise(F.lit("test"))).drop("rank0", "n_c")


def poisson1_cdf(kmax: int = 11) -> list[float]:
    """Cumulative Poisson(1) probabilities P(X <= j), j = 0..kmax."""
    out, c = [], 0.0
    for j in range(kmax + 1):
        c += math.exp(-1) / math.factorial(j)
        out.append(c)
    return out


def poisson1_draw(u: Column) -> Column:
    """Inverse-CDF Poisson(1) draw from a uniform."""
    cdf = poisson1_cdf()
    expr = F.lit(len(cdf))
    for j in reversed(range(len(cdf))):
        expr = F.when(u < F.lit(cdf[j]), F.lit(j)).otherwise(expr)
    return expr


def _boot_draws(df: DataFrame, label: str, n_boot: int, seed: int, key: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, label, carried columns, b, w): the uniform is its own projection so the CASE ladder reads a column
    instead of re-evaluating md5 in every branch."""
    x = spread(df.select(key, label, *carry), key).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    x = x.withColumn("_u", md5_uniform(F.lit(str(seed)), F.lit("boot"), F.col("b").cast("string"), F.col(key)))
    return x.withColumn("w", poisson1_draw(F.col("_u"))).drop("_u")


def stratified_bootstrap(df: DataFrame, label: str, n_boot: int = 300, seed: int = 42, key: str = "row_id") -> DataFrame:
    """(b, key, label, w, weight): Poisson(1) count per (row, b), rescaled so that each
    class keeps its exact size in every replicate.  Map-side generation; only the
    per-(b, class) totals are shuffled."""
    x = _boot_draws(df, label, n_boot, seed, key)
    tot = bootstrap_totals(df, label, n_boot, seed, key).select("b", label, F.col("draws").alias("sum_w"), F.col("n_class").alias("n_c"))
    return x.join(tot, ["b", label]).withColumn("weight", F.col("w") * F.col("n_c") / F.col("sum_w"))


#: Entry of ``_draw_table`` for hashes that their first two bytes don't decide.
UNDECIDED = 255


def _draw_of(bits: np.ndarray) -> np.ndarray:
    """``poisson1_draw`` of uniforms given as their 52 bits."""
    return np.searchsorted(poisson1_cdf(), bits / 2.0**52, side="right")


def _draw_table() -> np.ndarray:
    """The draw of every hash by its first two bytes, read as a little-endian number."""
    low = np.arange(1 << 16, dtype=np.int64) << 36
    first, last = _draw_of(low), _draw_of(low + (1 << 36) - 1)
    return np.where(first == last, first, UNDECIDED)[np.arange(1 << 16, dtype=np.uint16).byteswap()]


def bootstrap_totals(df: DataFrame, label: str, n_boot: int = 300, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Per (b, class): class size, raw draw total, distinct rows drawn, max multiplicity.

    The draws are those of ``_boot_draws``, hashed a batch of rows at a time and counted where they are made: a batch sends on one row for
    each of its classes and replicates.
    """
    schema = T.StructType([T.StructField("b", T.IntegerType(), False), df.schema[label], *[T.StructField(c, T.LongType()) for c in ("_n", "_w", "_drawn", "_most")]])
    levels = len(poisson1_cdf()) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, times = _draw_table(), np.arange(levels)
        for batch in batches:
            if not batch.num_rows:
                continue
            tails = Tails([x.encode() for x in batch.column("_tail").to_pylist()])
            classes = batch.column(label).dictionary_encode(null_encoding="encode")
            kinds = len(classes.dictionary)
            cell = classes.indices.to_numpy().astype(np.int64) * levels
            for b in range(n_boot):
                beginning = f"{seed}|boot|{b}".encode()
                w = table[tails.first_words(beginning) & np.uint32(0xFFFF)]
                for i in np.flatnonzero(w == UNDECIDED).tolist():
                    w[i] = _draw_of(np.int64(int(hashlib.md5(beginning + tails.tails[i], usedforsecurity=False).hexdigest()[:13], 16)))
                seen = np.bincount(cell + w, minlength=kinds * levels).reshape(kinds, levels)
                n = seen.sum(1)
                most = levels - 1 - (seen[:, ::-1] > 0).argmax(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(kinds, b, np.int32)), classes.dictionary, *map(pa.array, (n, seen @ times, n - seen[:, 0], most))], names=schema.names)

    tail = F.coalesce(F.concat(F.lit("|"), F.col(key).cast("string")), F.lit(""))
    x = spread(df.select(key, label), key).select(F.col(label), tail.alias("_tail")).mapInArrow(count, schema)
    return x.groupBy("b", label).agg(F.sum("_n").alias("n_class"), F.sum("_w").alias("draws"), F.sum("_drawn").alias("rows_drawn"), F.max("_most").cast("int").alias("max_w"))


def learning_subsets(folded: DataFrame, k: int, seed: int = 42, key: str = "row_id", fractions=LEARNING_FRACTIONS) -> DataFrame:
    """nested train prefixes per outer fold: first floor(frac * n_train) train rows in md5 order
    (not stratified).  Returns the expanded train rows with ``size_idx`` = smallest subset containing the row."""
    # the order doesn't depend on the outer fold: base rows are ranked once, counting the earlier rows of every fold
    each = [f"_f{j}" for j in range(k)]
    x = folded.withColumns({c: (F.col("fold") == j).cast("long") for j, c in enumerate(each)})
    ranked = hash_rank(x, ["rep"], _hash(F.lit(seed), F.lit("lc"), F.col(key)), each, out="_rank")
    n_tr = fold_expansion(folded, k).filter(F.col("role") == "train").groupBy("rep", "outer").agg(F.count(F.lit(1)).alias("n_train"))
    train = fold_expansion(ranked, k).filter(F.col("role") == "train")
    earlier = F.col("_rank") - F.array(*[F.col(f"{c}_before") for c in each])[F.col("outer")]
    j = train.withColumn("rank0", earlier).drop("_rank", *each, *[f"{c}_before" for c in each]).join(F.broadcast(n_tr), ["rep", "outer"])
    sizes = [F.floor(F.lit(float(f)) * F.col("n_train")) for f in fractions]
    idx = F.lit(None).cast("int")
    for i in reversed(range(len(fractions))):
        idx = F.when(F.col("rank0") < sizes[i], F.lit(i)).otherwise(idx)
    return j.withColumn("size_idx", idx).filter(F.col("size_idx").isNotNull())


def fold_audit(folded: DataFrame, label_int: Column) -> DataFrame:
    """F8: test size and positives per (rep, fold); every fold must hold >= 1 positive."""
    return folded.groupBy("rep", "fold").agg(
        F.count(F.lit(1)).alias("n_test"), F.sum(label_int).cast("long").alias("n_pos_test")
    ).withColumn("has_positive", F.col("n_pos_test") >= 1)
