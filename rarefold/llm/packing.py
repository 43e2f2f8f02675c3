"""Best-fit packing by bin completion.

Documents become pieces of at most ``CAPACITY`` tokens. Only the histogram of piece lengths (at most
CAPACITY numbers, whatever the data) goes to the planner: branch and bound over fillings around the largest
piece left, pruned by the waste a better plan may still have, with best-fit decreasing as incumbent. A plan
is a list of patterns with multiplicities; tasks then place every piece by its rank among equal lengths.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rarefold.llm.common import checkpointed, map_batches, table
from rarefold.llm.tokens import encoder, tokenizer_path

CAPACITY = 2048
END_ID = 0
#: Search budgets of the planner: fillings tried per largest piece, branches kept, nodes beyond the first plan.
TRIES, BRANCHES, NODES = 300, 3, 4000
#: Pieces of one length ranked together.
RANKED = 20_000

Pattern = tuple[int, tuple[int, ...]]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): ids and one end id; a longer text's first piece is the shorter."""

    def step(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
        end = END_ID.to_bytes(4, "little")
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(path)([x or "" for x in batch.column("text").to_pylist()]), strict=True):
            ids += end
            n = len(ids) // 4
            cuts = [0, *range(n % capacity or min(n, capacity), n, capacity), n]
            for k, (a, b) in enumerate(pairwise(cuts)):
                for name, x in zip(out, (doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                    out[name].append(x)
        return out

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), step, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over whole classes: equal pieces go to equal bins together."""
    bins: dict[int, dict[tuple[int, ...], int]] = {}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r in bins if r >= size), default=None)
            if room is None:
                each = min(capacity // size, left)
                content, n, room = (size,) * each, left // each, capacity - size * each
                left -= n * each
            else:
                content, have = next(iter(bins[room].items()))
                each = min(room // size, left)
                n = min(have, left // each)
                if have == n:
                    del bins[room][content]
                    if not bins[room]:
                        del bins[room]
                else:
                    bins[room][content] = have - n
                content, room = content + (size,) * each, room - size * each
                left -= n * each
            held = bins.setdefault(room, {})
            held[content] = held.get(content, 0) + n
    return [(n, content) for held in bins.values() for content, n in held.items()]


def fillings(sizes: list[int], left: dict[int, int], room: int, most: int = BRANCHES, tries: int = TRIES) -> list[tuple[int, ...]]:
    """Fillings of ``room`` to which no piece can be added, least waste first; larger pieces are tried first."""
    found: list[tuple[int, int, tuple[int, ...]]] = []
    budget = [tries]

    def go(room: int, cap: int, chosen: tuple[int, ...]) -> bool:
        i = bisect_right(sizes, min(room, cap)) - 1
        fits = False
        for k in range(i, max(-1, i - 6), -1):
            s = sizes[k]
            if chosen.count(s) >= left[s]:
                continue
            fits = True
            budget[0] -= 1
            if go(room - s, s, (*chosen, s)) or budget[0] <= 0:
                return True
        if not fits and (len(found) < most or room < found[-1][0]):
            # a piece smaller than those looked at may still fit: then this filling is dominated
            k = bisect_right(sizes, min(room, cap)) - 1
            while k >= 0 and chosen.count(sizes[k]) >= left[sizes[k]]:
                k -= 1
            if k >= 0:
                return go(room - sizes[k], sizes[k], (*chosen, sizes[k]))
            found.append((room, len(chosen), chosen))
            found.sort()
            del found[most:]
            return len(found) == most and found[-1][0] == 0
        return False

    go(room, room, ())
    return [c for _, _, c in found] or [()]


def completion_plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[Pattern]:
    """Patterns (multiplicity, pieces) that hold every piece, in as few bins as the search finds."""
    counts = {s: n for s, n in counts.items() if n}
    total = sum(s * n for s, n in counts.items())
    best = best_fit_plan(counts, capacity)
    best_bins, least = sum(n for n, _ in best), -(-total // capacity)
    stack = [(counts, 0, 0, None)]
    steps, done = 0, False
    while stack and best_bins > least and not (done and steps > nodes):
        left, bins, waste, plan = stack.pop()
        steps += done
        if not left:
            done = True
            if bins < best_bins:
                best_bins, best = bins, []
                while plan:
                    best.append(plan[0])
                    plan = plan[1]
            continue
        if -(-(total + waste) // capacity) >= best_bins:
            done = True
            continue
        sizes = sorted(left)
        largest = sizes[-1]
        rest = {**left, largest: left[largest] - 1}
        for chosen in reversed(fillings(sizes, rest, capacity - largest)):
            content = (largest, *chosen)
            need = {s: content.count(s) for s in set(content)}
            n = min(left[s] // k for s, k in need.items())
            after = dict(left)
            for s, k in need.items():
                if after[s] == n * k:
                    del after[s]
                else:
                    after[s] -= n * k
            stack.append((after, bins + n, waste + n * (capacity - sum(content)), ((n, content), plan)))
    return best


def plan_table(plan: list[Pattern]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, pieces per bin, first bin, offset in the bin) in rank order."""
    out: dict[int, list] = {}
    rank: dict[int, int] = {}
    base = 0
    for n, content in plan:
        offset = 0
        for size in sorted(set(content), reverse=True):
            each = content.count(size)
            out.setdefault(size, []).append((rank.get(size, 0), each, base, offset))
            rank[size] = rank.get(size, 0) + n * each
            offset += each * size
        base += n
    return {s: np.array(r, np.int64) for s, r in out.items()}


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    Repeated rows are placed one by one, equal lengths in the order of a hash of the row; a null doc_id is a
    value like any other. An empty table gives no rows.
    """
    parts = checkpointed(parts)
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most ``capacity`` rows
    where = plan_table(completion_plan(counts, capacity))
    salts = sum(counts.values()) // RANKED + 1
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(own) - 1).join(first, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank")).alias("rank"))
    sent = parts.sparkSession.sparkContext.broadcast(where)  # patterns of at most ``capacity`` lengths, not of rows

    def step(batch: pa.RecordBatch) -> dict:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        seq, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for size in np.unique(length).tolist():
            rows = np.flatnonzero(length == size)
            t = sent.value[size]
            at = t[np.searchsorted(t[:, 0], rank[rows], side="right") - 1]
            k = rank[rows] - at[:, 0]
            seq[rows], offset[rows] = at[:, 2] + k // at[:, 1], at[:, 3] + k % at[:, 1] * size
        return {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": seq, "offset": offset}

    return map_batches(ranked, step, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), tokenizer_path()))
