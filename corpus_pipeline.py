"""The corpus pipeline: quality, language, near-duplicates, mixture, packing.

Each stage is written as Parquet and read again by the next one. All but the last return the columns of
``documents``; rows are told apart by all their columns, so null and repeated ids are kept right.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rarefold.llm import langid, mixing, packing, quality, simhash
from rarefold.llm.common import table
from rarefold.llm.tokens import tokenizer_path
from rarefold.session import scratch_path

#: A text whose cosine with its nearest language is lower has no language that could be told.
LEAST_COSINE = 0.1


def _rows(docs: DataFrame, *more) -> DataFrame:
    """(row, text, ...): whole rows as one column, so that no column of a stage clashes with theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"), *more)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (fitted on these documents' labels) doesn't reject."""
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(_rows(docs), machine, ("row",)).where("predicted = 1").select("row.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: some letter, and near enough to a learned language."""
    taught = docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    told = langid.identify(_rows(docs), langid.profiles(taught), ("row",))
    return told.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_COSINE)).select("row.*")


def _row_key(docs: DataFrame) -> Column:
    """SHA-256 of the whole row, nulls told from every value: rows have one key only if they are equal in all columns."""
    parts = []
    for c in docs.columns:
        value = F.col(f"`{c}`").cast("string")
        parts.append(F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.encode(F.concat(*parts), "UTF-8"), 256)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id (null ids last, ties by the key of the whole row)."""
    ids = (F.col("doc_id").isNull().alias("a"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("b"), _row_key(docs).alias("c"))
    found = simhash.near_duplicates(docs.select(F.struct(*ids).alias("doc_id"), "text"))
    first = found.where("doc_id = component_id").select("doc_id.*").distinct()
    kept = _rows(docs, *ids).join(first, ["a", "b", "c"], "left_semi")
    return kept.dropDuplicates(["a", "b", "c"]).select("row.*")


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of every document as the mixture has, none for some; rows equal in all columns share theirs."""
    key = _row_key(docs).alias("key")
    mixed = mixing.mix(docs.select(key.alias("doc_id"), "text", "source"))
    copies = mixed.groupBy(F.col("doc_id").alias("key")).agg(F.count("*").cast("int").alias("copies"))
    rows = _rows(docs, key).join(copies, "key").dropDuplicates(["key"])
    return rows.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset."""
    return packing.pack(packing.pieces(docs, tokenizer_path()))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", duplicate_stage),
    ("mixture", mixture_stage),
    ("packing", packing_stage),
]

#: The classifier, the profiles and the tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows go to the shared folder and are read again."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}_{name}")
            docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
