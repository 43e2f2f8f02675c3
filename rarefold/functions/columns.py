"""Column-expression helpers shared by the operators (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: two-sided 95 % normal quantile.
Z_975 = 1.959963984540054


def nan_to_null(c: Column) -> Column:
    """pandas merges NaN and null; Spark keeps both.  Normalise NaN to null."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def md5_uniform(*parts: Column | str) -> Column:
    """Deterministic U[0,1) from md5 of the '|'-joined parts (first 13 hex digits = 52 bits)."""
    h = F.md5(F.concat_ws("|", *[F.col(p) if isinstance(p, str) else p for p in parts]))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(16**13)


def safe_div(num: Column, den: Column) -> Column:
    """num / den, null when den = 0 (the NaN of the reference)."""
    return F.when(den != 0, num / den)


def zero_div(num: Column, den: Column) -> Column:
    """num / den, 0 when den = 0 (zero_division=0 of the metric library)."""
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


def wilson(k: Column, n: Column, z: float = Z_975) -> tuple[Column, Column]:
    """Wilson score interval for k successes of n; null when n = 0."""
    p = k / n
    z2 = z * z
    den = 1 + z2 / n
    centre = (p + z2 / (2 * n)) / den
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / den
    lo = F.when(n > 0, centre - half)
    hi = F.when(n > 0, centre + half)
    return lo, hi


def reason_value(c: Column, is_string: bool) -> Column:
    """repr-like text of a failing value: strings quoted, numbers as Spark prints them."""
    if is_string:
        return F.concat(F.lit("'"), c, F.lit("'"))
    return c.cast("string")


def linspace_edges(n_bins: int) -> list[float]:
    """Inner bin edges exactly as ``numpy.linspace(0, 1, n+1)[1:-1]`` computes them (i * step)."""
    step = 1.0 / n_bins
    return [i * step for i in range(1, n_bins)]


def edge_bin(score: Column, edges: list[float]) -> Column:
    """Number of edges <= score: the left-closed bin index of ``numpy.digitize``."""
    acc = F.lit(0)
    for e in edges:
        acc = acc + F.when(score >= F.lit(float(e)), 1).otherwise(0)
    return acc


def threshold_bucket(score: Column, n: int = 1000) -> Column:
    """Largest i in [0, n] with i * (1/n) <= score (the 1001-point threshold grid)."""
    step = 1.0 / n
    c = F.floor(score * n).cast("long")
    adj = (
        F.when((c + 1) * F.lit(step) <= score, c + 1)
        .when(c * F.lit(step) > score, c - 1)
        .otherwise(c)
    )
    return F.greatest(F.least(adj, F.lit(n)), F.lit(-1))
