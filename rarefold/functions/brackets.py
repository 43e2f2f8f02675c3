"""Exact quantiles of many overlapping row sets without copying rows.

Rows carry a small *group* (fold, residue, label ...); every row set is a union of groups.  Each round counts
rows per (group, span, bin), which map-side aggregation shrinks to groups x attributes x bins; at first the
span is an attribute's whole value range.  The driver finds the bins that hold the wanted ranks: each run of
neighbouring ones is a span of the next round, so ranks far apart do not keep what lies between them.  Once a
span holds few rows, or one value, exact counts finish it.  The bins follow the
data, so a narrow range (295-305) is spread as well as any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 2048
#: Most (group, value) counts of an attribute brought to the driver by one round; its spans share them.
FEW = 200_000


def clean(c):
    """A double with NaN read as null and infinities kept at the ends of the number line."""
    x = c.cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.least(x, F.lit(1.7976931348623157e308)), F.lit(-1.7976931348623157e308)))


def set_quantiles(base: DataFrame, group: list[str], attrs: list[str], sets: dict, qs: Iterable[float] = (0.5,), few: int = FEW) -> dict:
    """{(set, attr, q): linear-interpolated quantile or None}; ``sets``: name -> predicate on a group tuple."""
    qs = tuple(qs)

    def ends(_, n: int) -> list[int]:
        return [k for q in qs for k in (int(np.floor(q * (n - 1))), int(np.ceil(q * (n - 1))))]

    found, sizes = set_ranks(base, group, attrs, sets, ends, few)
    out: dict = {}
    for s in sets:
        for a in attrs:
            n = sizes.get((s, a), 0)
            for q in qs:
                pos = q * (n - 1)
                if n:
                    low, high = found[s, a, int(np.floor(pos))], found[s, a, int(np.ceil(pos))]
                out[s, a, q] = low + (high - low) * (pos - np.floor(pos)) if n else None
    return out


def set_ranks(base: DataFrame, group: list[str], attrs: list[str], sets: dict, ranks: Callable[[object, int], list[int]], few: int = FEW) -> tuple[dict, dict]:
    """({(set, attr, rank): value at that 0-based rank among the set's non-null values}, {(set, attr): their number})."""
    keep = base.select(*group, *[clean(F.col(a)).alias(a) for a in attrs])
    found: dict = {}
    sizes: dict = {}
    for_range = keep.agg(*[f(a).alias(f"{n}_{a}") for a in attrs for n, f in (("lo", F.min), ("hi", F.max))]).first()
    spans = [Span(a, for_range[f"lo_{a}"], for_range[f"hi_{a}"], {}, None) for a in attrs if for_range[f"lo_{a}"] is not None]
    while spans:
        bins = {a: max(16, BINS // sum(x.attr == a for x in spans)) for a in attrs if any(x.attr == a for x in spans)}
        place = []
        for x in spans:
            nb = bins[x.attr]
            width = x.hi / nb - x.lo / nb
            at = F.when(F.col(x.attr) >= F.lit(x.hi), nb - 1).otherwise(F.least(F.floor((F.col(x.attr) - F.lit(x.lo)) / F.lit(width)), F.lit(nb - 1))) if width > 0 else F.lit(0)
            place.append(at.cast("int"))
        counts = _inside(keep, group, spans, place).groupBy(*group, "span", "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        hist: list[dict] = [{} for _ in spans]
        ends: list[dict] = [{} for _ in spans]
        for r in counts:
            nb = bins[spans[r.span].attr]
            hist[r.span].setdefault(tuple(r[c] for c in group), np.zeros(nb, np.int64))[r.bin] = r.n
            lo, hi = ends[r.span].get(r.bin, (np.inf, -np.inf))
            ends[r.span][r.bin] = (min(lo, r.lo), max(hi, r.hi))
        narrower: list[Span] = []
        for x, h, end in zip(spans, hist, ends, strict=True):
            if x.targets is None:
                x.targets = {}
                for s, member in sets.items():
                    sizes[s, x.attr] = n = int(sum(v.sum() for g, v in h.items() if member(g)))
                    if n:
                        x.targets[s] = sorted(set(ranks(s, n)))
            need: dict[int, dict] = {}  # bin: set: ranks
            for s, wanted in x.targets.items():
                edge = sum((v for g, v in h.items() if sets[s](g)), np.zeros(bins[x.attr], np.int64)).cumsum() + x.under(sets[s])
                for k, b in zip(wanted, np.searchsorted(edge, wanted, side="right").tolist(), strict=True):
                    need.setdefault(b, {}).setdefault(s, []).append(k)
            for run in _runs(sorted(need), bins[x.attr]):
                first, last = run[0], run[-1]
                at = [end[b] for b in range(first, last + 1) if b in end]
                below = {g: x.below.get(g, 0) + (int(h[g][:first].sum()) if g in h else 0) for g in x.below.keys() | h.keys()}
                targets: dict = {}
                for b in run:
                    for s, wanted in need[b].items():
                        targets.setdefault(s, []).extend(wanted)
                narrower.append(Span(x.attr, min(e[0] for e in at), max(e[1] for e in at), below, targets, int(sum(v[first : last + 1].sum() for v in h.values()))))
        share = {a: few // max(1, sum(x.attr == a for x in narrower)) for a in attrs}
        ready = [x for x in narrower if x.rows <= share[x.attr] or x.lo == x.hi]
        spans = [x for x in narrower if not (x.rows <= share[x.attr] or x.lo == x.hi)]
        for x, rows in zip(ready, _exact(keep, group, ready) if ready else (), strict=True):
            for s, wanted in x.targets.items():
                values = sorted((v, c) for g, v, c in rows if sets[s](g))
                v = np.array([y[0] for y in values])
                edge = x.under(sets[s]) + np.cumsum([y[1] for y in values])
                for k in wanted:
                    found[s, x.attr, k] = float(v[np.searchsorted(edge, k, side="right")])
    return found, sizes


@dataclass
class Span:
    """A value range of an attribute, each group's rows under it, and the ranks of each set that lie in it."""

    attr: str
    lo: float
    hi: float
    below: dict
    targets: dict | None
    rows: int = 0

    def under(self, member: Callable) -> int:
        return sum(n for g, n in self.below.items() if member(g))


def _runs(need: list[int], bins: int) -> list[list[int]]:
    """Runs of neighbouring bins; one of more than half of the bins would not narrow the span and is taken apart."""
    out: list[list[int]] = []
    for b in need:
        if out and b == out[-1][-1] + 1:
            out[-1].append(b)
        else:
            out.append([b])
    return [part for run in out for part in ([run] if 2 * len(run) <= bins else [[b] for b in run])]


def _inside(keep: DataFrame, group: list[str], spans: list[Span], place: list) -> DataFrame:
    """(group, span, bin, v) of every value in a span; an attribute's spans do not overlap."""
    cols: dict = {}
    for i, (x, at) in enumerate(zip(spans, place, strict=True)):
        inside = (F.col(x.attr) >= F.lit(x.lo)) & (F.col(x.attr) <= F.lit(x.hi))
        cols[x.attr] = cols.get(x.attr, F).when(inside, F.struct(F.lit(i).alias("span"), at.alias("bin"), F.col(x.attr).alias("v")))
    # nulls go after the explosion: a lambda inside it would be interpreted row by row
    return keep.select(*group, F.explode(F.array(*cols.values())).alias("s")).where(F.col("s").isNotNull()).select(*group, "s.*")


def _exact(keep: DataFrame, group: list[str], spans: list[Span]) -> list[list[tuple]]:
    """(group, value, count) of each span; only called for few rows or one value."""
    out: list[list[tuple]] = [[] for _ in spans]
    for r in _inside(keep, group, spans, [F.lit(0)] * len(spans)).groupBy(*group, "span", "v").agg(F.count("*").alias("n")).collect():
        out[r.span].append((tuple(r[c] for c in group), r.v, r.n))
    return out
