"""Approximate nearest neighbours by inner product: stable projections, a kd-tree, a chi-square stop.

With M the largest norm, a candidate p becomes (p, sqrt(M^2 - |p|^2)) and a query (q, 0): the largest inner
product is the smallest distance, d^2 = |q|^2 + M^2 - 2 q.p. A Gaussian projection to ``M_DIMS`` numbers
keeps projected^2 / d^2 chi-square distributed. Leaves of a kd-tree over the projections are taken nearest
first and their vectors verified; a query stops when, by the chi-square test, a vector as near as its
k-th best would lie beyond the next leaf with probability under 1 - ``SURE``.

The tree's upper part, from a bounded sample, deals the vectors to cells; a query goes only to cells its test
doesn't rule out, its first bound being the k-th best of the sample. Cells with many vectors and
their queries are split into blocks; every vector is indexed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rarefold.llm.common import checkpointed, map_batches, ship, table

K = 20
QUERY_EVERY = 20
M_DIMS = 8
SURE = 0.98
SEED = 11
#: Rows of the sample for the upper tree and the first bounds; most cells; vectors of a cell aimed at, of a block, of a leaf; queries of a block.
SAMPLE, MAX_CELLS, CELL_ROWS, BLOCK_ROWS, LEAF_ROWS, QUERY_ROWS = 4096, 512, 4096, 16384, 128, 2048
#: Kept beside the k best until scores are computed exactly.
SPARE = 12


def chi_square_bound(dims: int, sure: float) -> float:
    """x with P(chi-square of an even number of ``dims`` <= x) = sure."""

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(dims // 2))

    lo, hi = 0.0, 1000.0
    for _ in range(100):
        lo, hi = (lo, (lo + hi) / 2) if below((lo + hi) / 2) >= sure else ((lo + hi) / 2, hi)
    return hi


def projection(dims: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(dims + 1, M_DIMS))


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Projections of candidates, with the coordinate that makes all norms equal."""
    rest = np.sqrt(np.maximum(top * top - (x * x).sum(1), 0))
    a = projection(x.shape[1])
    return x @ a[:-1] + rest[:, None] * a[-1]


class UpperTree:
    """Cells of a kd-tree over sample projections."""

    def __init__(self, y: np.ndarray, cells: int):
        self.splits: list[tuple[int, float, int, int]] = []  # axis, value, left, right; below 0: a cell
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        self._grow(y, cells, np.full(M_DIMS, -np.inf), np.full(M_DIMS, np.inf))

    def _grow(self, y: np.ndarray, cells: int, lo: np.ndarray, hi: np.ndarray) -> int:
        axis = int(np.argmax(np.ptp(y, axis=0))) if len(y) else 0
        if cells <= 1 or len(y) < 2 or np.ptp(y[:, axis]) == 0:
            self.boxes.append((lo, hi))
            return -len(self.boxes)
        value = float(np.median(y[:, axis]))
        if (y[:, axis] < value).sum() == 0:
            value = float(np.min(y[y[:, axis] > value, axis]))
        place = len(self.splits)
        self.splits.append((axis, value, 0, 0))
        left, right = y[:, axis] < value, y[:, axis] >= value
        high, low = hi.copy(), lo.copy()
        high[axis] = low[axis] = value
        a, b = self._grow(y[left], cells // 2, lo, high), self._grow(y[right], cells - cells // 2, low, hi)
        self.splits[place] = (axis, value, a, b)
        return place

    def cell(self, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(y), np.int32)
        work = [(0 if self.splits else -1, np.arange(len(y)))]
        while work:
            node, rows = work.pop()
            if node < 0:
                out[rows] = -node - 1
            elif len(rows):
                axis, value, a, b = self.splits[node]
                left = y[rows, axis] < value
                work += [(a, rows[left]), (b, rows[~left])]
        return out

    def far(self, y: np.ndarray) -> np.ndarray:
        """Squared distance of every projection to every cell."""
        return np.column_stack([box_distance(y, lo[None], hi[None])[:, 0] for lo, hi in self.boxes])


def box_distance(y: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    out = np.zeros((len(y), len(lo)))
    for k in range(y.shape[1]):
        out += np.maximum(np.maximum(lo[None, :, k] - y[:, None, k], y[:, None, k] - hi[None, :, k]), 0) ** 2
    return out


def leaves(y: np.ndarray) -> list[np.ndarray]:
    """Rows of the leaves of a balanced kd-tree."""
    out, work = [], [np.arange(len(y))]
    while work:
        rows = work.pop()
        if len(rows) <= LEAF_ROWS:
            out.append(rows)
            continue
        axis = int(np.argmax(np.ptp(y[rows], axis=0)))
        half = len(rows) // 2
        order = np.argpartition(y[rows, axis], half)
        work += [rows[order[:half]], rows[order[half:]]]
    return out


def search(q: np.ndarray, q_id: np.ndarray, bound: np.ndarray, p: np.ndarray, p_id: np.ndarray, top: float, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query its k best of p found: (query row, vec_id, score), own id left out. ``bound``: a known upper bound of the k-th d^2."""
    y = lifted(p, top)
    parts = leaves(y)
    lo, hi = np.stack([y[r].min(0) for r in parts]), np.stack([y[r].max(0) for r in parts])
    far = box_distance(q @ projection(q.shape[1])[:-1], lo, hi)
    order = np.argsort(far, axis=1, kind="stable")
    chi = chi_square_bound(M_DIMS, SURE)
    norm = (q * q).sum(1) + top * top
    wide = k + SPARE
    score, place = np.full((len(q), wide), -np.inf), np.full((len(q), wide), -1)
    ids = np.r_[p_id, np.iinfo(np.int64).max]  # the last stands for an empty place
    active = np.arange(len(q))
    for t in range(len(parts)):
        nearest = order[active, t]
        reach = np.minimum(bound[active], np.maximum(norm[active] - 2 * score[active, k - 1], 0)) * chi
        go = far[active, nearest] <= reach + 1e-9
        active, nearest = active[go], nearest[go]
        if not len(active):
            break
        by = np.argsort(nearest, kind="stable")
        for rows in np.split(active[by], np.flatnonzero(np.diff(nearest[by])) + 1):
            part = parts[order[rows[0], t]]
            s = np.round(q[rows] @ p[part].T, 13)
            s[q_id[rows, None] == p_id[None, part]] = -np.inf
            better = (s >= score[rows, -1:]).any(1) & np.isfinite(s).any(1)
            rows, s = rows[better], s[better]
            if not len(rows):
                continue
            if s.shape[1] > wide:  # the best of the leaf, all of those that tie with the last
                cut = np.partition(s, s.shape[1] - wide, axis=1)[:, -wide]
                s = np.where(s >= np.maximum(cut, score[rows, -1])[:, None], s, -np.inf)
            both = np.concatenate([score[rows], s], axis=1)
            where = np.concatenate([place[rows], np.broadcast_to(part, s.shape)], axis=1)
            best = np.lexsort((ids[where], -both), axis=1)[:, :wide]
            score[rows], place[rows] = np.take_along_axis(both, best, 1), np.take_along_axis(where, best, 1)
            place[rows] = np.where(np.isfinite(score[rows]), place[rows], -1)
    row, at = np.nonzero(place >= 0)
    pick = place[row, at]
    exact = np.concatenate([(q[row[a : a + 65536]] * p[pick[a : a + 65536]]).sum(1) for a in range(0, max(len(row), 1), 65536)])
    best = np.lexsort((p_id[pick], -exact, row))
    row, pick, exact = row[best], pick[best], exact[best]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], p_id[pick[first]], exact[first]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors that take part. Null ids and vectors, zero ones, those with a null or non-finite
    part, and those whose length isn't the most usual one (ties: the smaller) take none."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    return rows.where(F.size("v") == (usual.d if usual else 0))


def nearest(vectors: DataFrame, every: int = QUERY_EVERY, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id divides by ``every`` its k nearest found.

    Ties go to the smaller vec_id; equal vectors are candidates of each other, also under a repeated id, but
    never a row of the query's own id. Fewer candidates than k: all that are reached. Empty table: no rows.
    """
    ship(vectors.sparkSession)
    base = usable(vectors)
    n, top2 = base.agg(F.count("*"), F.max(F.expr("aggregate(v, double(0), (a, x) -> a + x * x)"))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    top = math.sqrt(top2) * (1 + 1e-12)
    seen = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()  # bounded by SAMPLE
    sample, sample_id = _matrix(seen.column("v")), seen.column("vec_id").to_numpy()
    tree = UpperTree(lifted(sample, top), min(MAX_CELLS, -(-n // CELL_ROWS)))
    sent = vectors.sparkSession.sparkContext.broadcast((tree, sample, sample_id))
    chi = chi_square_bound(M_DIMS, SURE)

    def deal(batch: pa.RecordBatch) -> dict:
        x = _matrix(batch.column("v"))
        return {"vec_id": batch.column("vec_id"), "v": batch.column("v"), "cell": sent.value[0].cell(lifted(x, top))}

    def visit(batch: pa.RecordBatch) -> dict:
        tree, sample, sample_id = sent.value
        x, ids = _matrix(batch.column("v")), batch.column("vec_id").to_numpy()
        row, cell, bound = [], [], []
        for a in range(0, len(x), 1024):
            q = x[a : a + 1024]
            s = q @ sample.T
            s[ids[a : a + 1024, None] == sample_id[None]] = -np.inf
            kth = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(q), -np.inf)
            d2 = np.maximum((q * q).sum(1) + top * top - 2 * kth, 0)
            far = tree.far(q @ projection(q.shape[1])[:-1])
            r, c = np.nonzero(far <= d2[:, None] * chi + 1e-9)
            row.append(r + a), cell.append(c), bound.append(d2[r])
        row = np.concatenate(row)
        return {"vec_id": ids[row], "v": batch.column("v").take(pa.array(row)), "cell": np.concatenate(cell).astype(np.int32), "bound": np.concatenate(bound)}

    cells = checkpointed(map_batches(base, deal, "vec_id long, v array<double>, cell int"))
    asked = checkpointed(map_batches(base.where(F.col("vec_id") % every == 0), visit, "vec_id long, v array<double>, cell int, bound double"))
    size = cells.groupBy("cell").agg((F.floor(F.count("*") / BLOCK_ROWS) + 1).cast("int").alias("blocks"))
    askers = asked.groupBy("cell").agg((F.floor(F.count("*") / QUERY_ROWS) + 1).cast("int").alias("q_blocks"))
    shape = checkpointed(size.join(askers, "cell"))
    own = cells.join(shape, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
    ask = asked.join(shape, "cell").withColumn("q_block", F.pmod(F.xxhash64("vec_id"), "q_blocks").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ("cell", "block", "q_block")

    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        q_id = right.column("vec_id").to_numpy()
        row, vec, score = search(_matrix(right.column("v")), q_id, right.column("bound").to_numpy(), _matrix(left.column("v")), left.column("vec_id").to_numpy(), top, k)
        return pa.Table.from_arrays([pa.array(q_id[row]), pa.array(vec), pa.array(score)], schema=out)

    own, ask = own.select(*key, "vec_id", "v"), ask.select(*key, "vec_id", "v", "bound")
    hits = own.groupBy(*key).cogroup(ask.groupBy(*key)).applyInArrow(found, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
