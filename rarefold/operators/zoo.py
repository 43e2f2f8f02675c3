"""H, J1, J2: the model zoo under leakage-free cross-validation.

The base rows (key, rep, fold, rank inside the class, label, features) are stored once. A CV cell is a
set of rows given by closed forms of the stratified rank, at up to three levels (outer fold, inner fold,
calibration fold), so no fold copy is ever stored or shuffled:

* preprocessing of every cell (median, mean, sd, class weights) comes from one aggregation by (fold,
  residue, label) and ``brackets.set_quantiles``;
* logistic models: batched Newton (``linear.newton``); a task adds up its base rows for all cells, nothing is expanded;
* calibrators are fitted for all cells at once, isotonic ones exactly (``isotonic``);
* shallow trees and boosting: Spark ML estimators, one fit per outer fold on a filter of the base rows; the unbounded tree and
  the forest are grown by ``forest``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rarefold.functions.brackets import clean, set_quantiles
from rarefold.functions.cache import keep
from rarefold.functions.columns import md5_uniform
from rarefold.operators import isotonic, linear

# Model names in report order (dummies first).
MODEL_NAMES = (
    "dummy_most_frequent", "dummy_stratified", "tree_default", "tree_shallow_balanced",
    "logistic_balanced", "logistic_plain", "rf_balanced", "gradient_boosting",
)
# Fixed value: regularisation grid of the nested search.
C_GRID = (0.01, 0.1, 1.0, 10.0)
#: Most steps of all isotonic maps of one pass that are broadcast; n rows a map have O(n^(2/3)) at worst, n^(1/3) as a rule.
MOST_STEPS = 1 << 22


def get_model(name: str) -> str:
    if name not in MODEL_NAMES:
        raise KeyError(f"unknown model {name!r}; known: {', '.join(MODEL_NAMES)}")
    return name


# ------------------------------------------------------------ cells

@dataclass(frozen=True)
class Cell:
    """Training rows: not in ``outer``, nor (if >= 0) in ``inner`` of the rest, nor in ``cal`` of what is left."""

    rep: int
    outer: int
    inner: int = -1
    cal: int = -1
    C: float = 1.0
    size: int = -1  # learning curve: number of its subset

    def child(self, j: int) -> Cell:
        return Cell(self.rep, self.outer, j, -1, self.C) if self.inner < 0 else Cell(self.rep, self.outer, self.inner, j, self.C)


@dataclass
class Folded:
    """Base rows stored once, and what is known of the groups that make up every cell."""

    base: DataFrame  # row_id, rep, fold, rank0, y, features (NaN read as null)
    feats: list[str]
    k: int
    k_inner: int = 3
    k_cal: int = 3
    label: str = "y"
    groups: dict = field(default_factory=dict)

    @property
    def period(self) -> int:
        return self.k_inner * self.k_cal

    def reps(self) -> list[int]:
        return sorted({g[0] for g in self.counts()})

    def group(self) -> DataFrame:
        return self.base.withColumn("qm", F.pmod(F.floor(F.col("rank0") / self.k), F.lit(self.period)).cast("int"))

    def counts(self) -> dict:
        """(rep, fold, qm, y) -> counts, nulls and centred sums of the features; one aggregation."""
        if not self.groups:
            mid = self.base.agg(*[F.coalesce(F.avg(f), F.lit(0.0)).alias(f) for f in self.feats]).first()
            self.centre = [mid[f] for f in self.feats]
            aggs = [F.count("*").alias("n")]
            for f, c in zip(self.feats, self.centre, strict=True):
                x = F.col(f) - F.lit(c)
                aggs += [F.count(f).alias(f"n_{f}"), F.coalesce(F.sum(x), F.lit(0.0)).alias(f"s_{f}"), F.coalesce(F.sum(x * x), F.lit(0.0)).alias(f"q_{f}")]
            for r in self.group().groupBy("rep", "fold", "qm", self.label).agg(*aggs).collect():
                self.groups[r["rep"], r["fold"], r["qm"], r[self.label]] = (r["n"], [(r[f"n_{f}"], r[f"s_{f}"], r[f"q_{f}"]) for f in self.feats])
        return self.groups

    def trains(self, cell: Cell, g: tuple) -> bool:
        rep, fold, qm = g[:3]
        if rep != cell.rep or fold == cell.outer:
            return False
        r = fold + self.k * qm
        p = r - (r + self.k - 1 - cell.outer) // self.k
        if cell.inner < 0:
            return True
        if p % self.k_inner == cell.inner:
            return False
        if cell.cal < 0:
            return True
        s = p - (p + self.k_inner - 1 - cell.inner) // self.k_inner
        return s % self.k_cal != cell.cal


@dataclass
class Prefixes(Folded):
    """Cells whose training rows are those of the other folds up to a cut of the column ``lc``."""

    cuts: dict = field(default_factory=dict)  # Cell -> cut

    def group(self) -> DataFrame:
        edges = sorted(set(self.cuts.values()))
        above = sum((F.when(F.col("lc") > F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))
        return self.base.withColumn("qm", above.cast("int"))

    def trains(self, cell: Cell, g: tuple) -> bool:
        edges = sorted(set(self.cuts.values()))
        return g[0] == cell.rep and g[1] != cell.outer and g[2] <= edges.index(self.cuts[cell])


def folded_base(folded: DataFrame, feats: list[str], k: int, k_inner: int = 3, k_cal: int = 3, extra: Iterable[str] = ()) -> Folded:
    """``folded`` (row_id, rep, fold, rank0, y, features) as base rows; stored once, columns cut to these."""
    cols = ["row_id", "rep", "fold", "rank0", F.col("y").cast("int").alias("y"), *[clean(F.col(f)).alias(f) for f in feats], *extra]
    return Folded(keep(folded.select(*cols)), list(feats), k, k_inner, k_cal)


def without(r: Column, fold: Column, k: int) -> Column:
    """Rank among the rows that are not in ``fold``, of the rows ranked ``r`` and dealt by r mod k."""
    return r - F.floor((r + F.lit(k - 1) - fold) / F.lit(k))


def outer_cells(f: Folded, C: float = 1.0) -> list[Cell]:
    return [Cell(rep, o, C=C) for rep in f.reps() for o in range(f.k)]


def inner_cells(f: Folded, cells: list[Cell], grid: Iterable[float] | None = None) -> list[Cell]:
    n = f.k_inner if cells and cells[0].inner < 0 else f.k_cal
    return [Cell(x.rep, x.outer, x.inner, x.cal, c) for p in cells for j in range(n) for x in [p.child(j)] for c in (grid or (p.C,))]


# ------------------------------------------------------------ preprocessing

def fit_prep(f: Folded, cells: list[Cell]) -> dict[Cell, dict]:
    """Per cell: medians, means and population sd after imputation (0 -> 1), rows and positives; no row is copied."""
    counts = f.counts()
    shape = {replace(c, C=1.0) for c in cells}
    med = set_quantiles(f.group(), ["rep", "fold", "qm"], f.feats, {c: (lambda g, c=c: f.trains(c, g)) for c in shape})
    done = {}
    for c in shape:
        mine = [(g, v) for g, v in counts.items() if f.trains(c, g)]
        n = sum(v[0] for _, v in mine)
        pos = sum(v[0] for g, v in mine if g[3] == 1)
        stat = {"n": n, "pos": pos, "median": [], "mean": [], "sd": []}
        for i, (x, mid) in enumerate(zip(f.feats, f.centre, strict=True)):
            m = med.get((c, x, 0.5))
            m = mid if m is None else m
            have, s, q = (sum(v[1][i][j] for _, v in mine) for j in range(3))
            miss = n - have
            mean = (s + miss * (m - mid)) / max(n, 1)
            var = max((q + miss * (m - mid) ** 2) / max(n, 1) - mean * mean, 0.0)
            sd = var**0.5
            stat["median"].append(float(m)), stat["mean"].append(float(mid + mean)), stat["sd"].append(float(sd) if sd > 1e-12 * max(1.0, abs(mid)) else 1.0)
        done[c] = stat
    return {c: done[replace(c, C=1.0)] for c in cells}


def cell_table(f: Folded, prep: dict[Cell, dict], balanced: bool = False, more: dict[Cell, dict] | None = None) -> DataFrame:
    """One row per cell: its folds, C, class weights and feature statistics (``more``: further doubles)."""
    names, rows = None, []
    for i, (c, s) in enumerate(prep.items()):
        w = (s["n"] / (2.0 * max(s["n"] - s["pos"], 1)), s["n"] / (2.0 * max(s["pos"], 1))) if balanced else (1.0, 1.0)
        extra = (more or {}).get(c, {})
        names = list(extra)
        rows.append((i, c.rep, c.outer, c.inner, c.cal, float(c.C), *w, *[float(x) for j in range(len(f.feats)) for x in (s["median"][j], s["mean"][j], s["sd"][j])], *extra.values()))
    schema = "cell int, c_rep int, c_outer int, c_inner int, c_cal int, C double, w0 double, w1 double"
    schema += "".join(f", {a}{j} double" for j in range(len(f.feats)) for a in ("_md", "_mn", "_sd"))
    schema += "".join(f", `{n}` {'array<double>' if isinstance((more or {})[next(iter(prep))][n], list) else 'double'}" for n in names or [])
    return f.base.sparkSession.createDataFrame(rows, schema)


def expand(f: Folded, table: DataFrame, role: str) -> DataFrame:
    """In-flight rows of every cell: 'train', or 'held' (the rows its deepest level leaves out); scaled to z0..zd."""
    j = f.base.join(F.broadcast(table), F.col("rep") == F.col("c_rep"))
    p = without(F.col("rank0"), F.col("c_outer"), f.k)
    s = without(p, F.col("c_inner"), f.k_inner)
    out, inn, cal = F.col("fold") == F.col("c_outer"), F.pmod(p, F.lit(f.k_inner)) == F.col("c_inner"), F.pmod(s, F.lit(f.k_cal)) == F.col("c_cal")
    deep, flat = F.col("c_cal") >= 0, F.col("c_inner") < 0
    if role == "train":
        j = j.where(~out & (flat | (~inn & (~deep | ~cal))))
    else:
        j = j.where(F.when(flat, out).when(~deep, ~out & inn).otherwise(~out & ~inn & cal))
    j = j.withColumn("w", F.when(F.col("y") == 1, F.col("w1")).otherwise(F.col("w0")))
    for i, x in enumerate(f.feats):
        j = j.withColumn(f"z{i}", (F.coalesce(F.col(x), F.col(f"_md{i}")) - F.col(f"_mn{i}")) / F.col(f"_sd{i}"))
    return j


def zs(f: Folded) -> list[str]:
    return [f"z{i}" for i in range(len(f.feats))]


def fit_cells(f: Folded, prep: dict[Cell, dict], balanced: bool) -> dict[Cell, dict]:
    """Newton fits of all cells; coefficients, ``converged``."""
    order, d = list(prep), len(f.feats)
    weights = {c: (s["n"] / (2.0 * max(s["n"] - s["pos"], 1)), s["n"] / (2.0 * max(s["pos"], 1))) if balanced else (1.0, 1.0) for c, s in prep.items()}
    found = linear.newton(lambda beta, active: _cell_sums(f, prep, weights, beta, [i for i, c in enumerate(order) if prep[c]["n"]] if active is None else [i for (i,) in active]), d)
    return {order[i]: {**{f"b{j}": float(b[j]) for j in range(d + 1)}, "conv": float(ok)} for (i,), (b, ok, _) in sorted(found.items())}


def _cell_sums(f: Folded, prep: dict[Cell, dict], weights: dict, beta: dict, active: list[int]) -> list:
    """Loss, C, gradient and Hessian sums of the cells numbered ``active``; a task reads its base rows once for all of them."""
    order, feats, d = list(prep), list(f.feats), len(f.feats)
    rows = f.group().select("rep", "fold", "qm", F.col(f.label).alias("y"), *feats)
    known = sorted({g[:3] for g in f.counts()})
    # cells that differ in C only have the same rows and the same scaled features
    shapes: dict[Cell, list[tuple]] = {}
    for i in active:
        c = order[i]
        shapes.setdefault(replace(c, C=1.0), []).append((i, float(c.C), weights[c], np.asarray(beta.get((i,), np.zeros(d + 1)), float)))
    tables = []
    for mine in shapes.values():
        c = order[mine[0][0]]
        table = np.zeros((1 + max(g[1] for g in known), 1 + max(g[2] for g in known)), bool)
        for g in known:
            table[g[1:]] |= f.trains(c, g)
        tables.append((c.rep, table, [np.array(prep[c][k], float) for k in ("median", "mean", "sd")], mine))
    pairs = [(a, b) for a in range(d + 1) for b in range(a, d + 1)]
    names = ["loss", *[f"g{a}" for a in range(d + 1)], *[f"h{a}_{b}" for a, b in pairs]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        at: dict[int, float] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rep, fold, qm = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "fold", "qm"))
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in feats])
            gaps = np.isnan(x)
            for its_rep, table, (median, mean, sd), mine in tables:
                use = np.flatnonzero(table[fold, qm] & (rep == its_rep))
                if not len(use):
                    continue
                z = np.ones((d + 1, len(use)))
                z[1:] = (np.where(gaps[:, use], median[:, None], x[:, use]) - mean[:, None]) / sd[:, None]
                label = y[use]
                for i, big_c, (w0, w1), b in mine:
                    e = np.clip(b @ z, -linear.MARGIN, linear.MARGIN)
                    small = np.exp(-np.abs(e))
                    p = np.where(e >= 0, 1.0, small) / (1.0 + small)
                    w = np.where(label == 1, w1, w0)
                    h = (z * (w * p * (1 - p))) @ z.T
                    loss = w @ (np.log1p(small) + np.maximum(e, 0.0) - label * e)
                    at[i] = big_c
                    held[i] = held.get(i, 0.0) + np.r_[loss, z @ (w * (p - label)), [h[q] for q in pairs]]
        if held:
            values = np.array(list(held.values())).T
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([at[i] for i in held]), *[pa.array(v) for v in values]], names=["cell", "C", *names])

    parts_of = rows.mapInArrow(run, "cell int, C double, " + ", ".join(f"{n} double" for n in names))
    return parts_of.groupBy("cell").agg(F.sum("loss").alias("loss"), F.max("C").alias("C"), *[F.sum(n).alias(n) for n in names[1:]]).collect()


def eta(f: Folded, suffix: str = "") -> Column:
    return sum((F.col(f"b{j + 1}{suffix}") * F.col(f"z{j}{suffix}") for j in range(len(f.feats))), F.col(f"b0{suffix}"))


def _scored(rows: DataFrame, name: str | Column, score: Column) -> DataFrame:
    model = name if isinstance(name, Column) else F.lit(name)
    return rows.withColumn("score", score).select(
        model.alias("model"), "rep", F.col("c_outer").alias("fold"), "row_id", "y", "score", (F.col("score") > 0.5).cast("int").alias("pred"), (F.col("conv") == 1).alias("converged"))


# ------------------------------------------------------------ logistic models

def logistic_scores(f: Folded, cells: list[Cell], balanced: bool, name: str) -> DataFrame:
    """Scores of the rows each cell holds out."""
    prep = fit_prep(f, cells)
    table = cell_table(f, prep, balanced, fit_cells(f, prep, balanced))
    return _scored(expand(f, table, "held"), name, linear.sigmoid(eta(f)))


def logistic_cv(f: Folded, balanced: bool, C: float = 1.0, name: str | None = None) -> DataFrame:
    """Out-of-fold scores of plain / balanced logistic regression for every (rep, outer) cell."""
    return logistic_scores(f, outer_cells(f, C), balanced, name or ("logistic_balanced" if balanced else "logistic_plain"))


def grid_search_c(f: Folded, grid=C_GRID, balanced: bool = True) -> DataFrame:
    """Mean inner-fold AP per (rep, outer, C) of the balanced logistic model."""
    from rarefold.operators.metrics import average_precision

    cells = inner_cells(f, outer_cells(f), grid)
    prep = fit_prep(f, cells)
    table = cell_table(f, prep, balanced, fit_cells(f, prep, balanced))
    held = expand(f, table, "held").select("rep", F.col("c_outer").alias("outer"), F.col("c_inner").alias("inner"), "C", "y", linear.sigmoid(eta(f)).alias("score"), "conv")
    order = F.array_position(F.array(*[F.lit(float(c)) for c in grid]), F.col("C")) - 1
    ap = average_precision(held, ["rep", "outer", "inner", "C"])
    fits = table.groupBy(F.col("c_rep").alias("rep"), F.col("c_outer").alias("outer"), "C").agg((F.min("conv") == 1).alias("converged"))
    out = ap.groupBy("rep", "outer", "C").agg(F.avg("average_precision").alias("mean_ap"))
    return out.join(fits, ["rep", "outer", "C"]).select("rep", "outer", "C", order.cast("int").alias("c_order"), "mean_ap", "converged")


def best_c(grid_table: DataFrame) -> DataFrame:
    """Highest mean AP, first in grid order on ties."""
    return grid_table.groupBy("rep", "outer").agg(
        F.max_by("C", F.struct(F.col("mean_ap"), -F.col("c_order"))).alias("best_C"),
        F.max("mean_ap").alias("best_inner_ap"),
    )


def nested_cv(f: Folded, grid=C_GRID, balanced: bool = True) -> tuple[DataFrame, DataFrame]:
    """Refit each outer training part with its best C; (scored outer test rows, best C with how often it won)."""
    bc = keep(best_c(grid_search_c(f, grid, balanced)))
    won = {(r["rep"], r["outer"]): r["best_C"] for r in bc.collect()}
    cells = [Cell(rep, o, C=won[rep, o]) for rep, o in sorted(won)]
    wins = bc.groupBy("best_C").agg(F.count("*").alias("c_wins"))
    return logistic_scores(f, cells, balanced, "logistic_nested"), bc.join(F.broadcast(wins), "best_C")


# ------------------------------------------------------------ calibration

def calibrators(f: Folded, parents: list[Cell], kinds: tuple[str, ...]) -> tuple[dict[Cell, dict], list[list[tuple]]]:
    """Per parent cell the coefficients of its calibration models and their sigmoids; per parent the isotonic maps of its models.

    All models of all parents are one batch of Newton steps, all sigmoids another; the isotonic maps of the margin are exact
    fits of all cells in one job, read by linear interpolation, ends held.
    """
    cells = inner_cells(f, parents)
    prep = fit_prep(f, cells)
    coefs = fit_cells(f, prep, False)
    table = cell_table(f, prep, False, coefs)
    held = expand(f, table, "held").withColumn("margin", eta(f))
    more: dict[Cell, dict] = {c: dict(coefs[c]) for c in cells}
    order = list(prep)
    if "platt" in kinds:
        n = {r["cell"]: (r["p"], r["n"]) for r in held.groupBy("cell").agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect()}
        targets = f.base.sparkSession.createDataFrame([(i, (p + 1.0) / (p + 2.0), 1.0 / (t - p + 2.0)) for i, (p, t) in n.items()], "cell int, t1 double, t0 double")
        aim = held.join(F.broadcast(targets), "cell").withColumn("t", F.when(F.col("y") == 1, F.col("t1")).otherwise(F.col("t0")))
        for r in linear.fit_logistic(aim, ["cell"], ["margin"], "t", None, 1.0, penalize=False).collect():
            c = order[r["cell"]]
            more[c] |= {"a0": r["b0"], "a1": r["b1"], "conv": more[c]["conv"] * float(r["converged"])}
    maps: list = [isotonic.knots(pd.DataFrame())] * len(order)
    if "isotonic" in kinds:
        steps = keep(isotonic.isotonic_blocks(held, "cell", "margin", "y"))
        if (many := steps.count()) > MOST_STEPS:
            raise ValueError(f"{many} steps of isotonic maps are too many to broadcast (MOST_STEPS = {MOST_STEPS}); score fewer cells at a time")
        for i, blocks in steps.toPandas().groupby("cell"):
            maps[i] = isotonic.knots(blocks)
    out = {}
    for p in parents:
        wide: dict = {}
        for j in range(f.k_inner if p.inner < 0 else f.k_cal):
            c = p.child(j)
            s = prep[c]
            wide |= {f"{k}_{j}": v for k, v in more[c].items()}
            wide |= {f"{a}{i}_{j}": float(s[b][i]) for i in range(len(f.feats)) for a, b in (("_md", "median"), ("_mn", "mean"), ("_sd", "sd"))}
        wide["conv"] = min(more[p.child(j)]["conv"] for j in range(f.k_inner if p.inner < 0 else f.k_cal))
        out[p] = wide
    place = {c: i for i, c in enumerate(order)}
    return out, [[maps[place[p.child(j)]] for j in range(f.k_inner if p.inner < 0 else f.k_cal)] for p in parents]


def read_maps(spark: SparkSession, maps: list[list[tuple]], cell: Column, margins: list[Column]) -> Column:
    """Mean over a cell's calibration models of the isotonic map of each margin."""
    sent = spark.sparkContext.broadcast(maps)

    @F.pandas_udf(T.DoubleType())
    def read(cell: pd.Series, margin: pd.DataFrame) -> pd.Series:
        at, m = cell.to_numpy(), margin.to_numpy()
        out = np.zeros(len(at))
        for c in np.unique(at):
            of = at == c
            out[of] = np.mean([np.interp(m[of, j], *k) for j, k in enumerate(sent.value[c])], axis=0)
        return pd.Series(out)

    return read(cell, F.struct(*[x.alias(f"m{j}") for j, x in enumerate(margins)]))


def calibrated_scores(f: Folded, parents: list[Cell], kinds: tuple[str, ...], plain: bool = False, balanced: bool = False) -> DataFrame:
    """Scores of the rows each parent holds out, one row per (row, model): the mean of its calibration models' probabilities.

    ``plain`` / ``balanced`` add the uncalibrated logistic models. One pass over the base rows scores all of them.
    """
    prep = fit_prep(f, parents)
    more, maps = calibrators(f, parents, kinds) if kinds else ({p: {"conv": 1.0} for p in parents}, [])
    d = len(f.feats)
    for tag, wanted in (("plain", plain), ("even", balanced)):
        if wanted:
            for p, c in fit_cells(f, prep, tag == "even").items():
                more[p] |= {f"{tag}{j}": c[f"b{j}"] for j in range(d + 1)} | {"conv": min(more[p]["conv"], c["conv"])}
    rows = expand(f, cell_table(f, prep, False, more), "held")
    n = f.k_inner if parents[0].inner < 0 else f.k_cal
    scores: list[Column] = []
    for tag, wanted, name in (("plain", plain, "logistic_plain"), ("even", balanced, "logistic_balanced")):
        if wanted:
            e = sum((F.col(f"{tag}{j + 1}") * F.col(f"z{j}") for j in range(d)), F.col(f"{tag}0"))
            scores.append(F.struct(F.lit(name).alias("model"), linear.sigmoid(e).alias("score")))
    if kinds:
        for j in range(n):
            z = [(F.coalesce(F.col(x), F.col(f"_md{i}_{j}")) - F.col(f"_mn{i}_{j}")) / F.col(f"_sd{i}_{j}") for i, x in enumerate(f.feats)]
            rows = rows.withColumn(f"m_{j}", sum((F.col(f"b{i + 1}_{j}") * z[i] for i in range(d)), F.col(f"b0_{j}")))
    for kind in kinds:
        if kind == "platt":
            each = [linear.sigmoid(F.col(f"a0_{j}") + F.col(f"a1_{j}") * F.col(f"m_{j}")) for j in range(n)]
            mean = sum(each[1:], each[0]) / n
        else:
            rows = rows.withColumn("iso", read_maps(f.base.sparkSession, maps, F.col("cell"), [F.col(f"m_{j}") for j in range(n)]))
            mean = F.col("iso")
        scores.append(F.struct(F.lit(f"logistic_plain_{kind}").alias("model"), mean.alias("score")))
    rows = rows.select("rep", "c_outer", "c_inner", "row_id", "y", "conv", F.explode(F.array(*scores)).alias("s")).select("*", F.col("s.model").alias("model_name"), F.col("s.score").alias("s_score"))
    return _scored(rows, F.col("model_name"), F.col("s_score"))


def platt_cv(f: Folded) -> DataFrame:
    """Plain logistic wrapped in sigmoid calibration with an internal CV."""
    return calibrated_scores(f, outer_cells(f), ("platt",))


def isotonic_cv(f: Folded) -> DataFrame:
    """Plain logistic wrapped in isotonic calibration with an internal CV."""
    return calibrated_scores(f, outer_cells(f), ("isotonic",))


def cost_variant_scores(f: Folded) -> tuple[DataFrame, DataFrame]:
    """(inner out-of-fold scores of every outer training part, outer test scores) of the four variants."""
    outer = outer_cells(f)
    both = ("platt", "isotonic")
    return calibrated_scores(f, inner_cells(f, outer), both, True, True), calibrated_scores(f, outer, both, True, True)


# ------------------------------------------------------------ dummies

def dummy_cv(folded: DataFrame, k: int, strategy: str, seed: int = 42) -> DataFrame:
    """H1/H2: majority class of each training part, or a seeded draw with its prevalence."""
    per = folded.groupBy("rep", "fold").agg(F.count(F.lit(1)).alias("n_f"), F.sum("y").alias("p_f"))
    tot = per.groupBy("rep").agg(F.sum("n_f").alias("n_all"), F.sum("p_f").alias("p_all"))
    prev = per.join(tot, "rep").select("rep", "fold", ((F.col("p_all") - F.col("p_f")) / (F.col("n_all") - F.col("n_f"))).alias("prev"))
    j = folded.join(F.broadcast(prev), ["rep", "fold"])
    if strategy == "most_frequent":
        pred = (F.col("prev") > 0.5).cast("int")
        name = "dummy_most_frequent"
    else:
        u = md5_uniform(F.lit(str(seed)), F.lit("strat"), F.col("rep").cast("string"), F.col("fold").cast("string"), F.col("row_id"))
        pred = (u < F.col("prev")).cast("int")
        name = "dummy_stratified"
    return j.select(F.lit(name).alias("model"), "rep", "fold", "row_id", "y", pred.cast("double").alias("score"), pred.alias("pred"))


# ------------------------------------------------------------ Spark ML trees

#: Bins and rounds of the shallow models; trees without a depth limit are grown by ``forest``.
TREE_BINS, BOOST_BINS, BOOST_ROUNDS, TREE_MEMORY_MB = 256, 128, 100, 1024
#: Spark ML fits that run at the same time, and the training rows above which a fit runs alone, as it fills the cores and stores its rows.
FITS_AT_ONCE, ALONE_ROWS = 5, 1 << 23


def _estimator(name: str, seed: int):
    from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier

    common = {"featuresCol": "features", "labelCol": "y", "seed": seed, "maxMemoryInMB": TREE_MEMORY_MB, "cacheNodeIds": False}
    if name == "tree_shallow_balanced":
        return DecisionTreeClassifier(maxDepth=3, minInstancesPerNode=5, maxBins=TREE_BINS, weightCol="w", **common)
    if name == "gradient_boosting":
        return GBTClassifier(maxIter=BOOST_ROUNDS, stepSize=0.1, maxDepth=3, maxBins=BOOST_BINS, **common)
    raise KeyError(name)


def _vectors(rows: DataFrame, f: Folded, stat: dict) -> DataFrame:
    """Features imputed with the cell's medians, as a vector; class-balanced weights."""
    from pyspark.ml.feature import VectorAssembler

    x = rows.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in zip(f.feats, stat["median"], strict=True)})
    w = F.when(F.col("y") == 1, stat["n"] / (2.0 * max(stat["pos"], 1))).otherwise(stat["n"] / (2.0 * max(stat["n"] - stat["pos"], 1)))
    return VectorAssembler(inputCols=f.feats, outputCol="features").transform(x.withColumn("w", w).withColumn("y", F.col("y").cast("double")))


def spark_ml_cv(f: Folded, name: str, seed: int = 42) -> DataFrame:
    """Out-of-fold scores of a shallow Spark ML tree model: one fit per outer fold, a few at a time, on the stored base rows."""
    from pyspark.ml.functions import vector_to_array

    get_model(name)
    prep = fit_prep(f, outer_cells(f))

    def fitted(c: Cell) -> DataFrame:
        rows, stat = f.base.where(F.col("rep") == c.rep), prep[c]
        model = _estimator(name, seed).fit(_vectors(rows.where(F.col("fold") != c.outer), f, stat).select("features", "y", "w"))
        part = model.transform(_vectors(rows.where(F.col("fold") == c.outer), f, stat))
        return part.select(F.lit(name).alias("model"), "rep", "fold", "row_id", F.col("y").cast("int").alias("y"), vector_to_array("probability")[1].alias("score"), F.lit(False).alias("capped"))

    # as in Spark ML's CrossValidator: small jobs of several fits fill the cores that one fit leaves idle
    small = max(x["n"] for x in prep.values()) <= ALONE_ROWS
    with ThreadPool(min(FITS_AT_ONCE, len(prep)) if small else 1) as pool:
        parts = pool.map(inheritable_thread_target(f.base.sparkSession)(fitted), prep)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("pred", (F.col("score") > 0.5).cast("int"))


def whole(df: DataFrame, feats: list[str]) -> tuple[Folded, Cell, dict]:
    """All rows as the training part of one cell (explanation fits only)."""
    base = df.withColumn("rep", F.lit(0)).withColumn("fold", F.lit(0)).withColumn("rank0", F.lit(0).cast("long"))
    f, c = folded_base(base, feats, 1), Cell(0, -1)
    return f, c, fit_prep(f, [c])[c]


def tree_leaf_table(df: DataFrame, feats: list[str], seed: int = 42) -> tuple[DataFrame, dict]:
    """Shallow balanced tree fitted on ALL rows (explanation only): rows and positives
    per leaf, plus depth, leaf count, root attribute and importances."""
    from pyspark.ml.classification import DecisionTreeClassifier

    # features and label alone are stored, once: no step reads a key, and vectors are put together from them faster than they are read back
    f, _, stat = whole(df.select(F.lit(None).cast("string").alias("row_id"), "y", *feats), feats)
    x = _vectors(f.base, f, stat).select("features", "y", "w")
    est = DecisionTreeClassifier(maxDepth=3, minInstancesPerNode=5, maxBins=256, weightCol="w", featuresCol="features",
                                 labelCol="y", seed=seed, leafCol="leaf")
    model = est.fit(x)
    leaves = model.transform(x).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("n_pos"))
    import re

    first = re.search(r"feature (\d+)", model.toDebugString)
    info = {
        "depth": model.depth,
        "num_nodes": model.numNodes,
        "root_attr": feats[int(first.group(1))] if first else None,
        "importances": dict(zip(feats, [float(v) for v in model.featureImportances.toArray()])),
        "rules": model.toDebugString,
    }
    return leaves, info
