"""SimHash near-duplicates by a Gray-order hierarchical index.

1. Fingerprints: each text's majority bits over the XXH64 of its 3-word shingles.
2. Distinct fingerprints are dealt to buckets by each of four 16-bit blocks: two codes with at most
   three differing bits agree on one block at least. A bucket with more than ``heavy`` codes is dealt
   again by four 12-bit blocks of its other 48 bits, so a hot bucket splits and no link is lost.
3. Inside a bucket the codes are sorted by Gray rank. Runs of neighbours form the nodes of a tree; a
   node holds the bits all its codes share. A search goes down adding the differing bits of each
   node's newly shared bits, drops a whole group once more than the limit differ, and takes a whole
   group once even all its free bits could not exceed the limit.
4. A bucket emits a spanning forest of its links; ``common.connected`` joins the forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefold.llm.common import blocks, checkpointed, connected, map_batches, map_stream, texts_of, word_spans

WORDS = 3
MAX_BITS = 3
SEED = 42
FANOUT = 8
HEAVY = 4096
#: (query, node) pairs held at once, and codes gathered before a search.
FRONTIER = 1 << 21
GATHER = 1 << 17


def fingerprints_of(texts: list[bytes], words: int = WORDS) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for lo, hi in blocks(texts):
        group = [b" ".join(x.lower().split()) for x in texts[lo:hi]]
        joined = b" " + b"\n".join(group) + b" "
        _, s, e = word_spans(joined)
        ends = np.cumsum([len(x) + 1 for x in group])
        bound = np.concatenate([[0], np.searchsorted(s, ends + 1)])
        n_words = np.diff(bound)
        n = np.where(n_words == 0, 0, np.maximum(n_words - words + 1, 1))
        at = np.concatenate([[0], np.cumsum(n)])
        if not at[-1]:
            continue
        first = np.arange(at[-1]) - np.repeat(at[:-1], n) + np.repeat(bound[:-1], n)
        last = np.minimum(first + words, np.repeat(bound[1:], n)) - 1
        full = np.flatnonzero(n)
        total = np.zeros((len(full), 64), np.int64)
        for k in range(0, at[-1], 1 << 18):  # bits of a bounded number of shingles at a time
            part = slice(k, min(k + (1 << 18), at[-1]))
            h = np.array([digest(joined[i:j], SEED) for i, j in zip(s[first[part]].tolist(), e[last[part]].tolist(), strict=True)], np.uint64)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            owner = np.searchsorted(at[full], [part.start, part.stop - 1], side="right") - 1
            start = np.maximum(at[full[owner[0] : owner[1] + 1]] - part.start, 0)
            total[owner[0] : owner[1] + 1] += np.add.reduceat(bits, start, axis=0, dtype=np.int64)
        major = (2 * total > n[full, None]).astype(np.uint8)
        out[lo + full] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp long) of every row; doc_id of any type that has an order."""

    def step(batch: pa.RecordBatch) -> dict:
        return {"fp": fingerprints_of(texts_of(batch.column("text")), words).view(np.int64)}

    return map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), step, "fp long", ("doc_id",))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of a code in the order in which neighbours differ in one bit."""
    for k in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> np.uint64(k))
    return codes


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        if (lo == hi).all():
            return root
        np.minimum.at(root, hi, lo)
        while (root[root] != root).any():
            root = root[root]


def bucket_links(bucket: np.ndarray, codes: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of a spanning forest per bucket; ``bucket`` is sorted, codes are distinct in one."""
    order = np.lexsort((gray_rank(codes), bucket))
    bucket, codes = bucket[order], codes[order]
    n = len(codes)
    # levels[0]: one node per code; above, runs of FANOUT nodes of the same bucket
    first, ones, zeros, owner = np.arange(n), codes, ~codes, bucket
    levels = [(first, ones, zeros, np.arange(n + 1))]
    ends = np.arange(1, n + 1)
    while len(first) > 1 and (owner[1:] == owner[:-1]).any():
        new = np.r_[True, owner[1:] != owner[:-1]]
        start = np.flatnonzero(new)
        pos = np.arange(len(owner)) - np.repeat(start, np.diff(np.r_[start, len(owner)]))
        head = np.flatnonzero(pos % FANOUT == 0)
        ones, zeros = np.bitwise_and.reduceat(ones, head), np.bitwise_and.reduceat(zeros, head)
        child = np.r_[head, len(owner)]
        ends = ends[child[1:] - 1]
        first, owner = first[head], owner[head]
        levels.append((first, ones, zeros, child))
    left, right = [], []
    # neighbours in a group whose codes can differ in no more than the limit are all linked
    for k in range(1, len(levels)):
        f, o, z, _ = levels[k]
        stop = np.r_[f[1:], n]
        tight = np.bitwise_count(~(o | z)) <= limit
        inside = np.repeat(tight, stop - f)
        inside[f] = False
        at = np.flatnonzero(inside)
        left.append(at - 1), right.append(at)
    top = len(levels) - 1
    root_of = np.searchsorted(levels[top][0], np.arange(n), side="right") - 1
    step = max(1, FRONTIER // max(FANOUT, int(np.bincount(root_of).max())))
    for q0 in range(0, n, step):
        q = np.arange(q0, min(q0 + step, n))
        node = root_of[q]
        _, o, z, _ = levels[top]
        known = o[node] | z[node]
        far = np.bitwise_count((codes[q] ^ o[node]) & known).astype(np.int64)
        for k in range(top, 0, -1):
            f, o, z, child = levels[k]
            sub_first, sub_o, sub_z, _ = levels[k - 1]
            lo, width = child[node], child[node + 1] - child[node]
            at = np.repeat(lo - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(width.sum())
            q, far, known = np.repeat(q, width), np.repeat(far, width), np.repeat(known, width)
            mask = sub_o[at] | sub_z[at]
            far = far + np.bitwise_count((codes[q] ^ sub_o[at]) & mask & ~known)
            stop = np.r_[sub_first[1:], n][at]
            go = (far <= limit) & (stop > q + 1)
            free = np.bitwise_count(~mask)
            whole = go & (far + free <= limit)
            left.append(q[whole]), right.append(sub_first[at[whole]])
            go &= ~whole
            q, node, far, known = q[go], at[go], far[go], mask[go]
    a, b = np.concatenate(left) if left else np.zeros(0, int), np.concatenate(right) if right else np.zeros(0, int)
    a, b = a[a != b], b[a != b]
    root = _components(n, a, b)
    away = np.flatnonzero(root != np.arange(n))
    return codes[away], codes[root[away]]


def _search(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def links(key, fp):
        many = np.r_[False, key[1:] == key[:-1]]
        many[:-1] |= many[1:]
        u, v = bucket_links(key[many], fp[many].view(np.uint64), limit) if many.any() else (np.zeros(0, np.uint64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=schema)

    keys, fps, held = [], [], 0
    for batch in batches:
        keys.append(batch.column("key").to_numpy(zero_copy_only=False))
        fps.append(batch.column("fp").to_numpy(zero_copy_only=False))
        held += batch.num_rows
        if held >= GATHER:
            key, fp = np.concatenate(keys), np.concatenate(fps)
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield links(key[:cut], fp[:cut])
            keys, fps, held = [key[cut:]], [fp[cut:]], len(key) - cut
    if held:
        yield links(np.concatenate(keys), np.concatenate(fps))


def hamming_links(codes: DataFrame, limit: int = MAX_BITS, heavy: int = HEAVY) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of distinct ``fp`` at most ``limit`` <= 3 bits apart."""
    if not 0 <= limit <= 3:
        raise ValueError("four blocks find links of at most three bits")
    block = "(shiftrightunsigned(fp, 16 * j) & 65535)"
    dealt = codes.select("fp", F.explode(F.array(*[F.lit(j) for j in range(4)])).alias("j")).select("fp", "j", F.expr(f"shiftleft(cast(j as bigint), 16) | {block}").alias("key"))
    crowd = dealt.groupBy("key").count().where(F.col("count") > heavy).select("key", F.lit(True).alias("hot"))
    marked = dealt.join(crowd, "key", "left")
    # the 48 bits beside block j, as four blocks of 12
    beside = "(case when j = 3 then fp & (shiftleft(1L, 48) - 1) else shiftleft(shiftrightunsigned(fp, 16 * j + 16), 16 * j) | (fp & (shiftleft(1L, 16 * j) - 1)) end)"
    again = marked.where("hot").select("key", "fp", F.expr(beside).alias("rest"), F.explode(F.array(*[F.lit(j) for j in range(4)])).alias("k"))
    again = again.select(F.expr("shiftleft(1L, 40) | shiftleft(key, 14) | shiftleft(cast(k as bigint), 12) | (shiftrightunsigned(rest, 12 * k) & 4095)").alias("key"), "fp")
    rows = marked.where("hot is null").select("key", "fp").unionByName(again)
    rows = rows.repartition("key").sortWithinPartitions("key", "fp")
    return map_stream(rows, lambda it: _search(it, limit), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = WORDS, limit: int = MAX_BITS, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``.

    A null or empty text, or one of white space, has fingerprint zero and links like any other.
    Repeated rows and equal fingerprints are one code; a null doc_id joins its component but never
    names it. An empty table gives no rows; other columns are ignored. Texts of any length are whole.
    """
    mine = checkpointed(fingerprints(docs, words))
    codes = checkpointed(mine.groupBy("fp").agg(F.min("doc_id").alias("lo")))
    found = connected(hamming_links(codes.select("fp"), limit, heavy))
    named = codes.join(found, codes.fp == found.node, "left").select("fp", "lo", F.coalesce("root", "fp").alias("root"))
    named = checkpointed(named)
    least = named.groupBy("root").agg(F.min("lo").alias("component_id"))
    return mine.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    from rarefold.llm.common import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
