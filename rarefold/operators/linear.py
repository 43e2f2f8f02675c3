"""S3: batched L2-penalised logistic regression (Newton) for many cells at once.

A *cell* is one training problem (outer fold, inner fold, C, ...).  The training rows of all cells are an
in-flight expansion of the base rows (a broadcast join with the small cell table); nothing expanded is ever
stored.  Each Newton step is ONE grouped aggregation with map-side combine that returns, per cell, the loss,
the gradient and the Hessian's upper triangle; only those sums reach the driver.

Objective per cell (the metric library's convention, intercept not penalised):
    sum_i w_i * logloss(y_i, p_i) + ||beta||^2 / (2 C)
``y`` may be fractional (Platt targets).  Guards: margins are clipped to +-MARGIN for the probabilities, a
step that raises the loss is halved, and every cell carries ``converged`` into its result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARGIN = 30.0
MAX_ITER, TOL = 40, 1e-7


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(c, F.lit(MARGIN)), F.lit(-MARGIN))))


def fit_logistic(
    train: DataFrame,
    key: list[str],
    feats: list[str],
    label: str = "y",
    weight: str | None = None,
    C: float | str = 1.0,
    max_iter: int = MAX_ITER,
    tol: float = TOL,
    penalize: bool = True,
) -> DataFrame:
    """(key..., b0..bd, converged, iterations) of every cell; ``C``: a number or a per-cell column.

    ``train`` is read once per step and never stored: pass a cheap expansion of stored base rows.
    """
    spark, d = train.sparkSession, len(feats)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    cval = F.col(C).cast("double") if isinstance(C, str) else F.lit(float(C))
    base = train.select(*key, *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(feats)], F.col(label).cast("double").alias("_y"), w.alias("_w"), cval.alias("_C"))
    kinds = {f.name: f.dataType for f in base.schema.fields}
    schema = T.StructType([T.StructField(k, kinds[k]) for k in key] + [T.StructField(f"b{j}", T.DoubleType()) for j in range(d + 1)])
    xs = [F.lit(1.0)] + [F.col(f"x{i}") for i in range(d)]

    def sums(rows: DataFrame, eta: Column) -> list:
        rows = rows.withColumn("_e", F.greatest(F.least(eta, F.lit(MARGIN)), F.lit(-MARGIN)))
        p = 1 / (1 + F.exp(-F.col("_e")))
        s, r = F.col("_w") * p * (1 - p), F.col("_w") * (p - F.col("_y"))
        loss = F.col("_w") * (F.log1p(F.exp(-F.abs(F.col("_e")))) + F.greatest(F.col("_e"), F.lit(0.0)) - F.col("_y") * F.col("_e"))
        rows = rows.withColumn("_s", s).withColumn("_r", r)
        aggs = [F.sum(loss).alias("loss"), F.max("_C").alias("C")] + [F.sum(F.col("_r") * xs[a]).alias(f"g{a}") for a in range(d + 1)]
        aggs += [F.sum(F.col("_s") * xs[a] * xs[b]).alias(f"h{a}_{b}") for a in range(d + 1) for b in range(a, d + 1)]
        return rows.groupBy(*key).agg(*aggs).collect()

    def step_sums(beta: dict, active: list[tuple] | None) -> list:
        if active is None:
            return sums(base, F.lit(0.0))
        table = spark.createDataFrame([tuple(c) + tuple(map(float, beta[c])) for c in active], schema)
        return sums(base.join(F.broadcast(table), key), sum((F.col(f"b{k}") * xs[k] for k in range(1, d + 1)), F.col("b0")))

    fitted = newton(step_sums, d, max_iter, tol, penalize)
    full = T.StructType([*schema.fields, T.StructField("converged", T.BooleanType()), T.StructField("iterations", T.IntegerType())])
    return spark.createDataFrame([c + tuple(map(float, b)) + (ok, n) for c, (b, ok, n) in sorted(fitted.items())], full)


def newton(step_sums: Callable[[dict, list[tuple] | None], list], d: int, max_iter: int = MAX_ITER, tol: float = TOL, penalize: bool = True) -> dict:
    """{cell: (coefficients, converged, iterations)}; ``step_sums(beta, cells)`` gives each cell's loss, C, gradient and Hessian sums.

    At first (cells: None) every cell starts from zeros; later only the cells that go on are asked for.
    """
    sums_each = 2 + (d + 1) + (d + 1) * (d + 2) // 2  # the last columns of a row; the cell comes before them
    beta: dict = {}
    step: dict = {}
    last: dict = {}
    done: dict = {}
    iters: dict = {}
    for it in range(max_iter + 1):
        if it == 0:
            rows = step_sums(beta, None)
        else:
            active = [c for c in beta if not done[c]]
            if not active:
                break
            rows = step_sums(beta, active)
        for row in rows:
            c = tuple(row)[:-sums_each]
            b = beta.setdefault(c, np.zeros(d + 1))
            pen = np.full(d + 1, 1.0 / float(row["C"]) if penalize else 0.0)
            pen[0] = 0.0
            loss = row["loss"] + 0.5 * float(pen @ (b * b))
            if c in last and loss > last[c] + 1e-9 * abs(last[c]) and np.max(np.abs(step[c])) > tol:
                step[c] = step[c] / 2
                beta[c] = b + step[c]
                iters[c] = it
                continue
            if c in last and np.max(np.abs(step[c])) <= tol:
                done[c] = True
                continue
            g = np.array([row[f"g{a}"] for a in range(d + 1)]) + pen * b
            h = np.zeros((d + 1, d + 1))
            for a in range(d + 1):
                for k in range(a, d + 1):
                    h[a, k] = h[k, a] = row[f"h{a}_{k}"]
            h += np.diag(pen) + 1e-12 * np.eye(d + 1)
            s = np.linalg.lstsq(h, g, rcond=None)[0] if np.linalg.cond(h) > 1e14 else np.linalg.solve(h, g)
            last[c], step[c], done[c], iters[c] = loss, s, bool(np.max(np.abs(s)) <= tol), it + 1
            beta[c] = b - s
    return {c: (beta[c], bool(done[c]), int(iters[c])) for c in beta}


def margin(rows: DataFrame, coefs: DataFrame, key: list[str], feats: list[str], out: str = "margin") -> DataFrame:
    """Linear predictor b0 + sum b_j x_j per row, coefficients broadcast-joined by cell key."""
    d = len(feats)
    j = rows.join(F.broadcast(coefs.select(*key, *[f"b{k}" for k in range(d + 1)])), key)
    eta = F.col("b0") + sum((F.col(f"b{k + 1}") * F.col(f).cast("double") for k, f in enumerate(feats)), F.lit(0.0))
    return j.withColumn(out, eta).drop(*[f"b{k}" for k in range(d + 1)])
