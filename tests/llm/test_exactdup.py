import hashlib
import uuid

from pyspark.sql import functions as F

from rarefold.llm import exactdup
from rarefold.session import scratch_path


def written(spark, df, parts=3):
    path = scratch_path(spark, f"exact-test-{uuid.uuid4().hex}")
    df.repartition(parts).write.parquet(path)
    return path


def expect(df):
    groups = {}
    for r in df.select("doc_id", "text").collect():
        groups.setdefault(r.text or "", []).append(r.doc_id)
    rows = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        rows += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(rows, key=str), len(groups)


def found(rows):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.digest.hex()) for r in rows), key=str), sum(r["at"] == r.keep_at for r in rows)


def test_awkward_rows(spark, docs, no_docs):
    rows = exactdup.deduplicate(spark, exactdup.open_table(spark, written(spark, docs))).collect()
    assert found(rows) == expect(docs)
    assert exactdup.deduplicate(spark, exactdup.open_table(spark, written(spark, no_docs))).count() == 0


def test_one_file_a_batch_and_files_that_come_later(spark, docs):
    """State outlives a query: files added later meet the keys of the first run, after a restart from the checkpoint."""
    path, folder = written(spark, docs, 4), scratch_path(spark, f"exact-test-{uuid.uuid4().hex}")
    source = exactdup.open_table(spark, path)
    exactdup.follow(spark, source, folder, max_files=1)
    docs.withColumn("doc_id", F.col("doc_id") + 1000).coalesce(1).write.mode("append").parquet(path)
    states = exactdup.follow(spark, source, folder)
    assert found(exactdup.decide(spark, source, states).collect()) == expect(spark.read.parquet(path))


def test_colliding_digests_are_told_apart_by_their_bytes(spark, docs):
    path = written(spark, docs)
    weak = exactdup.open_table(spark, path, digest=lambda t: F.unhex(F.substring(F.md5(t), 1, 2)))
    hot = exactdup.follow(spark, weak, scratch_path(spark, f"exact-test-{uuid.uuid4().hex}"))
    assert hot.count() < docs.select("text").distinct().count()
    rows = exactdup.decide(spark, weak, hot).collect()
    want, n = expect(docs)
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in rows if r.doc_id is not None) == sorted(w[:3] for w in want if w[0] is not None)
    assert len(rows) == docs.count() and sum(r["at"] == r.keep_at for r in rows) == n


def test_hot_key_is_dealt_in_pieces(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    source = exactdup.open_table(spark, written(spark, df))
    states = exactdup.follow(spark, source, scratch_path(spark, f"exact-test-{uuid.uuid4().hex}"))
    hot = exactdup._hot(states).collect()
    assert [r.pieces for r in hot] == [334]
    rows = exactdup.decide(spark, source, states)
    assert rows.where("keep_id = 5997 and group_size = 2000").count() == 2000 and rows.where("at = keep_at").count() == 4001
