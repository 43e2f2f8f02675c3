"""Exact token ids at speed, and the exact length histogram.

The byte-level pre-tokenizer never joins across a single space between two other characters, so a text is
the concatenation of its space-separated parts, each encoded once per task and then looked up.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rarefold.llm.common import blocks, checkpointed, map_batches, table

TOKENIZER = "byte_bpe_50k.json"
#: Parts remembered by a task: a memory bound, nothing is left out when it is reached.
MEMO_PARTS, MEMO_CHARS, PART_CHARS = 250_000, 5_000_000, 80
BLOCK_CHARS = 1 << 20
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Fixed value: the split pattern of byte-level pre-tokenizers that use their own regular expression.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a visible character: itself, or the next code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_level_ranks(spec: dict) -> dict[bytes, int] | None:
    """Token bytes to ids, if the file is a plain byte-level BPE whose ids rise in the order of its merges."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    if model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("dropout"):
        return None
    vocab, byte = model["vocab"], _byte_of_char()
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(a >= b for a, b in pairwise(made)):
        return None
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}


class Encoder:
    """Texts to their ids as little-endian unsigned 32-bit bytes; no special tokens.

    The ids are those of the given tokenizer file. Where it is a plain byte-level BPE, parts are merged by
    a faster engine with the file's own ranks (the tests compare both); else the file's tokenizer does it all.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            ranks = byte_level_ranks(json.load(f))
        self.fast = tiktoken.Encoding("parts", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        if not ranks:
            self.base = Tokenizer.from_file(path)
            self.base.encode_special_tokens = True
        self.memo: tuple[dict, dict] = ({}, {})  # parts at a text's start, parts after a space
        self.chars = 0

    def _encode(self, parts: list[str]) -> list[bytes]:
        if self.fast is None:
            return [array("I", e.ids).tobytes() for e in self.base.encode_batch_fast(parts, add_special_tokens=False)]
        encode = self.fast.encode_ordinary
        return [array("I", encode(p)).tobytes() for p in parts]

    def _learn(self, kind: int, parts: set[str]) -> None:
        memo = self.memo[kind]
        new = [p for p in parts if p not in memo]
        fit = [p for p in new if p and p == p.strip()]
        memo.update(dict.fromkeys(new))  # None: white space at an end, not safe to split there
        memo.update(zip(fit, self._encode([" " + p for p in fit] if kind else fit), strict=True))
        self.chars += sum(map(len, new))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.fast is None:
            return [x for lo, hi in blocks(texts, BLOCK_CHARS) for x in self._encode(texts[lo:hi])]
        out: list[bytes] = []
        for lo, hi in blocks(texts, BLOCK_CHARS):
            split = [x.split(" ") for x in texts[lo:hi]]
            seen = ({p[0] for p in split}, set().union(*(p[1:] for p in split)))
            for kind in (0, 1):
                self._learn(kind, seen[kind])
            head, tail = self.memo[0].__getitem__, self.memo[1].__getitem__
            for text, parts in zip(texts[lo:hi], split, strict=True):
                try:
                    out.append(head(parts[0]) + b"".join(map(tail, parts[1:])))
                except TypeError:
                    out.append(self._careful(text))
            if len(self.memo[0]) + len(self.memo[1]) > MEMO_PARTS or self.chars > MEMO_CHARS:
                # the parts of the last block hold the frequent ones
                keep = {p: self.memo[1][p] for p in seen[1] if len(p) <= PART_CHARS}
                self.memo, self.chars = ({}, keep), sum(map(len, keep))
        return out

    def _careful(self, text: str) -> bytes:
        """Split only at single spaces between characters that are no white space."""
        if not text:
            return b""
        first, *rest = _SAFE_SPACE.split(text)
        known = self.memo[1]
        new = {p for p in rest if known.get(p) is None}
        extra = dict(zip(new, self._encode([" " + p for p in new]), strict=True)) if new else {}
        return self._encode([first])[0] + b"".join([known.get(p) or extra[p] for p in rest])


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded_lengths(docs: DataFrame, path: str, end_tokens: int = 0) -> DataFrame:
    """``length``: ids of every row's whole text plus ``end_tokens``; a null text has no ids."""

    def step(batch: pa.RecordBatch) -> dict:
        ids = encoder(path)([x or "" for x in batch.column("text").to_pylist()])
        return {"length": [len(x) // 4 + end_tokens for x in ids]}

    return map_batches(docs.select("text"), step, "length long")


def length_histogram(lengths: DataFrame, block: int = 1024) -> DataFrame:
    """One row per distinct length, as a context limit, with exact answers over all documents.

    n_docs and n_tokens of that length; docs_longer and tokens_longer, suffix sums beyond it; docs_total,
    tokens_total; truncated_total, the tokens left when every document is cut at the limit; cut_tokens,
    those lost; quantile, the share of documents no longer. Nulls are left out; an empty table gives no rows.
    Counts are summed before any shuffle; the sums run over blocks of lengths, then within a block.
    """
    one = checkpointed(lengths.where("length is not null").groupBy("length").agg(F.count("*").alias("n_docs")).withColumn("n_tokens", F.expr("length * n_docs")).withColumn("part", F.expr(f"length div {block}")))
    parts = one.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    later = Window.orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select("part", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in "dt"], F.sum("d").over(whole).alias("docs_total"), F.sum("t").over(whole).alias("tokens_total"))
    inside = Window.partitionBy("part").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = one.join(parts, "part").select(
        "length", "n_docs", "n_tokens", "docs_total", "tokens_total",
        (F.col("d_later") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).alias("docs_longer"),
        (F.col("t_later") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("tokens_longer"),
    )
    kept = F.col("tokens_total") - F.col("tokens_longer") + F.col("length") * F.col("docs_longer")
    return out.withColumn("truncated_total", kept).withColumn("cut_tokens", F.col("tokens_total") - kept).withColumn("quantile", 1 - F.col("docs_longer") / F.col("docs_total"))


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    return length_histogram(encoded_lengths(table(spark, sf_dir, "documents"), tokenizer_path()))
