"""Filter interaction audit: five filters, all 120 orders, in wide packed counters.

A document's failed filters are a mask of five bits. A mask fixes what happens at each of the 600 (order, step) places: the
document is kept, removed here, or was removed before though it fails this filter too. ``packed`` maps a mask to one big integer
with three counters for each place; a part's documents are audited by adding their masks' integers, times the number of documents
that share mask and labels. A counter is as wide as the part's document count, so no sum runs into its neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rarefold.llm.common import ship, table

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
PLACES = len(ORDERS) * len(FILTERS)
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3

AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failed(text: Column) -> Column:
    """Bits 0 to 3 of the mask: what the text alone decides. ``text`` has no nulls."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    tests = [n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame, part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part fail just these filters.

    Equal texts have equal bits 0 to 3, so copies are added up before they meet: a text's rows become one row for each
    (part, labels), and only those are compared with the smallest doc_id of the text. Rows without doc_id have no smaller one and
    are no smaller one; rows that repeat the smallest doc_id all pass E; a document with several label rows has any of their labels.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    thin = docs.select("doc_id", F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.sha2(F.encode(text, "UTF-8"), 256).alias("digest"), failed(text).alias("bits"))
    marks = labels.groupBy("doc_id").agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))])
    key = ["digest", "bits", "part", "good", "toxic"]
    rows = thin.join(marks, "doc_id", "left").na.fill(0, ["good", "toxic"]).groupBy(*key, "doc_id").agg(F.count("*").alias("n"))
    with_id = F.col("doc_id").isNotNull()
    groups = rows.groupBy(*key).agg(
        F.min(F.when(with_id, F.struct("doc_id", "n"))).alias("first"),
        F.coalesce(F.sum(F.when(with_id, F.col("n"))), F.lit(0)).alias("with_id"),
        F.coalesce(F.sum(F.when(~with_id, F.col("n"))), F.lit(0)).alias("without"),
    )
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))  # a text has at most four rows a part here
    groups = groups.withColumn("passes", F.col("without") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0))
    both = F.array(
        F.struct(F.col("bits").alias("mask"), F.col("passes").alias("n")),
        F.struct((F.col("bits") + 16).alias("mask"), (F.col("with_id") + F.col("without") - F.col("passes")).alias("n")),
    )
    counts = groups.select("part", "good", "toxic", F.inline(both)).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
    return counts


def outcomes(mask: int) -> Iterator[tuple[int, int, int]]:
    """(kept, removed, redundant) of a document with this mask at every place, orders first."""
    for order in ORDERS:
        gone = 0
        for name in order:
            fails = mask >> FILTERS.index(name) & 1
            yield int(not (gone or fails)), int(fails and not gone), int(fails and gone)
            gone |= fails


@cache
def packed(mask: int, width: int) -> int:
    """The mask's outcomes as one integer: three counters of ``width`` bits for each of the 600 places."""
    total = 0
    for k, three in enumerate(outcomes(mask)):
        for j, x in enumerate(three):
            total |= x << (3 * k + j) * width
    return total


def unpacked(total: int, width: int) -> list[tuple[int, ...]]:
    """The counters of a sum of packed integers; exact while every counter is under 2 ** width."""
    size = -(-3 * PLACES * width // 8)
    digits = int.from_bytes(total.to_bytes(size, "little"), "little")
    ones, out = (1 << width) - 1, []
    for _ in range(PLACES):
        out.append(tuple(digits >> j * width & ones for j in range(3)))
        digits >>= 3 * width
    return out


def audit_part(part: str, rows: list[tuple[int, int, int, int]]) -> dict[str, list]:
    """The 600 rows of a part from its (mask, good, toxic, n)."""
    width = max(sum(n for *_, n in rows), 1).bit_length()
    every = unpacked(sum(n * packed(m, width) for m, _, _, n in rows), width)
    good = unpacked(sum(n * packed(m, width) for m, g, _, n in rows if g), width)
    toxic = unpacked(sum(n * packed(m, width) for m, _, t, n in rows if t), width)
    places = [(order, step, order[step - 1]) for order in ORDERS for step in range(1, len(FILTERS) + 1)]
    shapley = {f: sum(x[1] for x, p in zip(every, places, strict=True) if p[2] == f) for f in FILTERS}
    last = {p[2]: x[1] for x, p in zip(every, places, strict=True) if p[1] == len(FILTERS)}  # passes all the others
    return {
        "part": [part] * PLACES,
        "filter_order": [p[0] for p in places],
        "step": [p[1] for p in places],
        "kept": [x[0] for x in every],
        "removed": [x[1] for x in every],
        "redundant": [x[2] for x in every],
        "unique_fails": [last[p[2]] for p in places],
        "good_lost": [x[1] for x in good],
        "toxic_lost": [x[1] for x in toxic],
        "shapley": [shapley[p[2]] for p in places],
    }


def audit(counts: DataFrame) -> DataFrame:
    """The audit of every part: 120 orders of five steps. At most 128 rows a part are gathered."""
    ship(counts.sparkSession)
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]])

    def step(group: pa.Table) -> pa.Table:
        rows = list(zip(*(group.column(c).to_pylist() for c in ("mask", "good", "toxic", "n")), strict=True))
        return pa.table(audit_part(group.column("part")[0].as_py(), rows), schema=schema)

    return counts.groupBy("part").applyInArrow(step, AUDIT)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


ORACLE_OP12 = r"""
WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, map {
    'A': len(w) < 200, 'B': 100 * list_unique(w) < 50 * len(w), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(words.doc_id > min(words.doc_id) OVER (PARTITION BY text), false)} AS f
  FROM words LEFT JOIN marks USING (doc_id)),
groups AS (SELECT part, good, toxic, f, count(*) AS n FROM fails GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
places AS (SELECT o, s::INTEGER AS s, o[s] AS x, list_filter(string_split(o[:s - 1], ''), lambda y: y <> '') AS earlier FROM orders, range(1, 6) t(s)),
seen AS (
  SELECT part, o, s, x, good, toxic, n, f[x] AS bad, len(list_filter(earlier, lambda y: f[y])) > 0 AS gone, len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda y: f[y])) = 1 AS single
  FROM groups, places),
sums AS (
  SELECT part, o, s, x, coalesce(sum(n) FILTER (NOT gone AND NOT bad), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (bad AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (bad AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (bad AND single), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (bad AND NOT gone AND good = 1), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (bad AND NOT gone AND toxic = 1), 0)::BIGINT AS toxic_lost
  FROM seen GROUP BY ALL)
SELECT part, o AS filter_order, s AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM sums"""
