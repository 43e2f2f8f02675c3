"""Exact deduplication as a stateful stream: disk-backed keyed state, full bytes checked on hits.

``follow`` streams a table's files through a keyed aggregation whose state lies in RocksDB and never expires.
A key is a text's digest; its state is how many rows had it, the stable identifier that stays (the largest
doc_id) and the content locator of that row: file and row number. Every micro-batch writes the states it
changed to the shared folder, under its number, so that a batch run again after a lost executor or driver writes the same files.

``check`` reads, by their locators, the retained content of every key that was hit and compares it with the full bytes of every
other row of the key. Rows that differ (a collision of digests) become classes of their own, told apart by whole texts.
``decide`` then gives every row its class.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from rarefold.llm.common import checkpointed
from rarefold.session import scratch_path

#: The state lies on disk; a task closes its store when it commits, as an open one keeps some megabytes whatever it holds.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}

#: Pieces into which rows are dealt: a key with more than one piece's share of all rows is salted, so at most this many keys are broadcast.
PIECES = 1000

#: Keys with copies up to which they are broadcast to the rows' texts; beyond, texts are shuffled by key.
BROADCAST_KEYS = 200_000


def sha256(text: Column) -> Column:
    """The 32 bytes of SHA-256 of the text in UTF-8."""
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


@dataclass(frozen=True)
class Table:
    """A Parquet table by its path, read as a stream and as a batch with the same row locators."""

    path: str
    schema: StructType
    id_col: str = "doc_id"
    text_col: str = "text"
    digest: Callable[[Column], Column] = sha256

    def arrivals(self, df: DataFrame, *more: Column) -> DataFrame:
        """(digest, doc_id, at, ...): ``at`` locates the row's content; a null text counts as empty."""
        text = F.coalesce(F.col(f"`{self.text_col}`").cast("string"), F.lit(""))
        at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        return df.select(self.digest(text).alias("digest"), F.col(f"`{self.id_col}`").alias("doc_id"), at.alias("at"), *more, text.alias("text"))

    def batch(self, spark: SparkSession, *more: Column) -> DataFrame:
        return self.arrivals(spark.read.schema(self.schema).parquet(self.path), *more)

    def stream(self, spark: SparkSession, max_files: int | None = None) -> DataFrame:
        reader = spark.readStream.schema(self.schema)
        path = f"{self.path[:-1]}[{self.path[-1]}]"  # a pattern: a stream takes a path without one for a folder, a table may be a single file
        return self.arrivals((reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path))


def open_table(spark: SparkSession, path: str, **columns) -> Table:
    return Table(path, spark.read.parquet(path).schema, **columns)


def follow(spark: SparkSession, source: Table, folder: str, max_files: int | None = None) -> DataFrame:
    """Drain the stream into the keyed state; (digest, size, doc_id, at): the last state of every key.

    May be called again on the same folder when files were added: the checkpoint knows which were read, the state goes on.
    """
    log = f"{folder}/states"

    def write_states(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    state = source.stream(spark, max_files).groupBy("digest").agg(F.count("*").alias("size"), F.max(F.struct("doc_id", "at")).alias("keep"))
    spark.createDataFrame([], state.schema).write.mode("overwrite").parquet(f"{log}/batch=-1")
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress").foreachBatch(write_states).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    states = spark.read.parquet(log)
    last = states.groupBy("digest").agg(F.max(F.struct("size", "keep")).alias("s"))  # sizes only grow
    return last.select("digest", "s.size", "s.keep.doc_id", "s.keep.at")


def _hot(states: DataFrame) -> DataFrame:
    """(digest, pieces) of the keys with over a PIECES-th of all rows: fewer than PIECES of them."""
    total = states.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return states.where(F.col("size") * PIECES > total).select("digest", F.expr(f"cast(ceil(size * {PIECES} / {max(total, 1)}) as int)").alias("pieces"))


def _salted(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows with ``salt``: 0, or for a hot key one of its pieces by the row's place."""
    return rows.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.pmod(F.xxhash64("at"), F.coalesce("pieces", F.lit(1))).cast("int")).drop("pieces")


def _spread(states: DataFrame, hot: DataFrame) -> DataFrame:
    """One copy of a key's row for each of its pieces."""
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))
    return states.join(F.broadcast(hot), "digest", "left").withColumn("salt", copies).drop("pieces")


def check(spark: SparkSession, source: Table, states: DataFrame, hot: DataFrame) -> DataFrame:
    """(digest): keys with a row whose bytes differ from the content that the state locates.

    Only rows of keys that were hit are compared, a copy in its key's piece.
    """
    hits = states.where("size > 1").select("digest", F.col("at").alias("kept_at"))
    few = hits.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    rows = source.batch(spark).join(F.broadcast(hits) if few else hits, "digest")
    kept = rows.where("at = kept_at").select("digest", F.col("text").alias("kept_text"))
    others = _salted(rows.where("at <> kept_at").select("digest", "at", "text"), hot)
    pairs = others.join(_spread(kept, hot), ["digest", "salt"])
    return pairs.where(F.col("text") != F.col("kept_text")).select("digest").distinct()


def decide(spark: SparkSession, source: Table, states: DataFrame) -> DataFrame:
    """(digest, doc_id, at, keep_id, keep_at, group_size) of every row; the row at ``keep_at`` stays."""
    states = checkpointed(states)
    hot = checkpointed(_hot(states))
    collided = checkpointed(check(spark, source, states, hot))
    keys = states.select("digest", F.col("doc_id").alias("keep_id"), F.col("at").alias("keep_at"), F.col("size").alias("group_size"))
    thin = source.batch(spark).drop("text")
    if collided.isEmpty():
        return _salted(thin, hot).join(_spread(keys, hot), ["digest", "salt"]).drop("salt")
    # different texts under one digest: their classes are told apart by the whole text
    clean = _salted(thin.join(collided, "digest", "left_anti"), hot).join(_spread(keys, hot), ["digest", "salt"]).drop("salt")
    mixed = source.batch(spark).join(collided, "digest", "left_semi")
    whole = mixed.groupBy("digest", "text").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "at")).alias("keep"))
    apart = mixed.join(whole, ["digest", "text"]).select("digest", "doc_id", "at", F.col("keep.doc_id").alias("keep_id"), F.col("keep.at").alias("keep_at"), "group_size")
    return clean.unionByName(apart)


def deduplicate(spark: SparkSession, source: Table, max_files: int | None = None) -> DataFrame:
    """Every row of the table with its class; see ``decide``.

    Null texts count as empty and equal to empty ones; of equal texts the largest doc_id stays (a null id only if all
    are null; among repeated ids the row that lies last); empty tables give no rows; other columns aren't read.
    """
    return decide(spark, source, follow(spark, source, scratch_path(spark, f"exact-{uuid.uuid4().hex}"), max_files))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deduplicate(spark, open_table(spark, f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "keep_id", F.col("group_size").cast(LongType()), (F.col("at") == F.col("keep_at")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_OP13 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""
