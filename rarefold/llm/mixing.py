"""Mixing sources to target weights, with DataFrame functions only.

w_s is proportional to p_s^a, p_s a source's share of all tokens. The exponent a in [0, 1] is bisected: the
largest that meets the target entropy, raised where a source would repeat more than ``max_repeats`` times.
The weights are realised as budgeted block permutations: every epoch of a source is a hash permutation of
its documents, taken while the source's token budget lasts; the running token place of a document, as a part
of its source's budget, names the block, so that every block holds the sources in their target weights.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rarefold.llm.common import checkpointed, table

#: A token here is a run of ``[^\x20\x09-\x0D]``; a document counts one at least.
WORDS = r"[^\x20\x09-\x0D]+"
EVENNESS = 0.95
MAX_REPEATS = 4.0
BLOCK_TOKENS = 200_000
SEED = 42
#: Halvings of the exponent's range, and parts tried by one job (2^4).
HALVINGS, PARTS = 40, 16
DIGITS = 9
HASH_DIGITS = 15


@dataclass(frozen=True)
class Target:
    """Entropy as a part of the largest possible (log of the number of sources), repetition limit, token budget (None: as many as there are)."""

    evenness: float = EVENNESS
    max_repeats: float = MAX_REPEATS
    budget: int | None = None
    block_tokens: int = BLOCK_TOKENS


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, name, tokens): ``name`` tells a null source from an empty one."""
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORDS))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.greatest(words, F.lit(1)).cast("long").alias("tokens")).withColumn("name", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))


def find_exponent(sources: DataFrame, n: int, total: int, target: Target) -> float:
    """Bisect the exponent over (name, t); each job returns one row."""
    budget = target.budget or total
    goal = target.evenness * math.log(n)
    share = F.col("t") / F.lit(total)

    def ok(a: list[float]) -> list[tuple[bool, bool]]:
        cols: list[Column] = []
        for x in a:
            w = F.pow(share, F.lit(x))
            z, d = F.sum(w), F.sum(w * F.log(share))
            cols += [F.log(z) - F.lit(x) * d / z, F.max(w / F.col("t")) / z * F.lit(float(budget))]
        r = sources.agg(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()
        return [(r[2 * k] >= goal, r[2 * k + 1] <= target.max_repeats) for k in range(len(a))]

    # entropy falls as the exponent grows: the largest exponent that still has it
    even = _section(lambda a: [x for x, _ in ok(a)], 0.0, 1.0)
    # repetition falls as the exponent grows: the smallest exponent within the limit
    few = 1.0 - _section(lambda a: [y for _, y in ok([1.0 - x for x in a])], 0.0, 1.0)
    return round(max(even, few), DIGITS)


def _section(holds, lo: float, hi: float) -> float:
    """The largest x in [lo, hi] for which ``holds``, true up to a point; ``lo`` if nowhere."""
    if holds([hi])[0]:
        return hi
    for _ in range(HALVINGS // int(math.log2(PARTS))):
        tried = [lo + (hi - lo) * k / PARTS for k in range(1, PARTS)]
        true = sum(holds(tried))
        lo, hi = ([lo, *tried][true], [*tried, hi][true])
    return lo


def weigh(sources: DataFrame, target: Target) -> DataFrame:
    """(name, t, weight, budget, epochs, rest): whole epochs of every source and the tokens of its last, partial one."""
    n, total = sources.agg(F.count("*"), F.sum("t")).first()
    if not n:
        return sources.selectExpr("name", "t", "0D weight", "0L budget", "0L epochs", "0L rest")
    a = find_exponent(sources, n, total, target)
    z = sources.agg(F.sum(F.pow(F.col("t") / F.lit(total), F.lit(a)))).first()[0]
    weight = F.round(F.pow(F.col("t") / F.lit(total), F.lit(a)) / F.lit(z), DIGITS)
    out = sources.withColumn("weight", weight).withColumn("budget", F.floor(F.col("weight") * F.lit(target.budget or total)))
    return out.withColumn("epochs", F.expr("budget div t")).withColumn("rest", F.expr("budget % t"))


#: Sources up to which all weights are broadcast, and the share of all tokens from which a source's weight always is.
FEW_SOURCES, HOT_SHARE = 100_000, 1000


def _weighted(base: DataFrame, weights: DataFrame) -> DataFrame:
    """The documents with their source's weight; no source, however large, is dealt to one task."""
    if weights.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES:
        return base.join(F.broadcast(weights), "name")
    total = weights.agg(F.sum("t")).first()[0]
    hot = weights.where(F.col("t") * HOT_SHARE > total)  # fewer than HOT_SHARE rows
    rest = base.join(F.broadcast(hot.select("name")), "name", "left_anti").join(weights, "name")
    return base.join(F.broadcast(hot), "name").unionByName(rest)


def _running(sums: DataFrame, whole: list[str], digits: int) -> DataFrame:
    """(..., part, t_before): tokens of the source's epoch in earlier parts, by runs of parts first, then within a run."""
    sums = sums.withColumn("run", F.shiftrightunsigned("part", 4 * (digits // 2)))
    runs = sums.groupBy(*whole, "run").agg(F.sum("t_part").alias("t_run"))
    earlier = Window.partitionBy(*whole).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*whole, "run", F.coalesce(F.sum("t_run").over(earlier), F.lit(0)).alias("t_runs"))
    within = Window.partitionBy(*whole, "run").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("t_within", F.coalesce(F.sum("t_part").over(within), F.lit(0))).join(runs, [*whole, "run"])
    return sums.select(*whole, "part", (F.col("t_runs") + F.col("t_within")).alias("t_before"))


def mix(docs: DataFrame, target: Target | None = None) -> DataFrame:
    """(doc_id, source, epoch, tokens, weight, block, place) of every copy of a document in the mixture.

    A null source is a source of its own, a null text counts one token, repeated rows are documents of
    their own, ties in hash go by doc_id and tokens. One source takes weight 1; an empty table gives no
    rows; extra columns are ignored. Hot sources are summed in hash buckets before any order is made.
    """
    target = target or Target()
    base = checkpointed(sized(docs))
    sources = checkpointed(base.groupBy("name").agg(F.sum("tokens").alias("t")))
    weights = checkpointed(weigh(sources, target))
    total, n = base.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    n_blocks = max(1, -(-(target.budget or total) // target.block_tokens))
    digits = max(2, math.ceil(math.log(max(n, 1) / 1000 + 1, 16)))
    copies = _weighted(base, weights).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs"))))
    md5 = F.md5(F.concat_ws("|", F.lit(str(SEED)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    key = F.conv(F.substring(md5, 1, HASH_DIGITS), 16, 10).cast("long")
    copies = copies.withColumn("key", key).withColumn("part", F.shiftrightunsigned("key", 4 * (HASH_DIGITS - digits)))
    whole = ["name", "epoch"]
    sums = copies.groupBy(*whole, "part").agg(F.sum("tokens").alias("t_part"))
    sums = _running(sums, whole, digits)
    inside = Window.partitionBy(*whole, "part").orderBy("key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    run = copies.withColumn("t_inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(sums, [*whole, "part"])
    run = run.withColumn("before", F.col("t_before") + F.col("t_inside"))
    run = run.where((F.col("epoch") < F.col("epochs")) | (F.col("before") + F.col("tokens") <= F.col("rest")))
    block = F.expr(f"cast(((epoch * t + before) * {n_blocks}) div budget as long)")
    run = run.withColumn("block", F.least(block, F.lit(n_blocks - 1)))
    order = Window.partitionBy("block").orderBy("key", "name", "doc_id", "epoch", "tokens")
    return run.select("doc_id", "source", F.col("epoch").cast("int").alias("epoch"), "tokens", "weight", "block", F.row_number().over(order).alias("place"))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The same mixture in DuckDB: the exponent by plain halving, one chained step each."""
    steps = ["e0 AS (SELECT 0.0::DOUBLE lo, 1.0::DOUBLE hi)", "f0 AS (SELECT 0.0::DOUBLE lo, 1.0::DOUBLE hi)"]
    for k in range(HALVINGS):
        steps.append(f"""e{k + 1} AS (SELECT CASE WHEN ok THEN m ELSE lo END lo, CASE WHEN ok THEN hi ELSE m END hi FROM
            (SELECT lo, hi, m, (SELECT ln(sum(pow(p, m))) - m * sum(pow(p, m) * ln(p)) / sum(pow(p, m)) FROM src) >= goal ok
             FROM (SELECT lo, hi, (lo + hi) / 2 m, {EVENNESS} * (SELECT ln(count(*)) FROM src) goal FROM e{k})))""")
        steps.append(f"""f{k + 1} AS (SELECT CASE WHEN ok THEN lo ELSE m END lo, CASE WHEN ok THEN m ELSE hi END hi FROM
            (SELECT lo, hi, m, (SELECT max(pow(p, m) / t) / sum(pow(p, m)) * any_value(total) FROM src) <= {MAX_REPEATS} ok
             FROM (SELECT lo, hi, (lo + hi) / 2 m FROM f{k})))""")
    return f"""
WITH base AS (
  SELECT doc_id, source, greatest(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')), 1)::BIGINT tokens,
         coalesce('s' || source, 'n') name FROM documents),
src AS (SELECT name, t, total, t / total::DOUBLE p FROM
  (SELECT name, sum(tokens)::BIGINT t, (sum(sum(tokens)) OVER ())::BIGINT total FROM base GROUP BY name)),
one AS (SELECT (SELECT ln(sum(pow(p, 1.0))) - sum(p * ln(p)) / sum(p) FROM src) >= {EVENNESS} * (SELECT ln(count(*)) FROM src) even1,
               (SELECT max(1 / t::DOUBLE * p) / sum(p) * any_value(total) FROM src) <= {MAX_REPEATS} few1,
               (SELECT max(1 / t::DOUBLE) / count(*) * any_value(total) FROM src) <= {MAX_REPEATS} few0),
{", ".join(steps)},
expo AS (SELECT round(greatest(CASE WHEN even1 THEN 1.0 ELSE (SELECT lo FROM e{HALVINGS}) END,
                               CASE WHEN few0 THEN 0.0 ELSE (SELECT hi FROM f{HALVINGS}) END), {DIGITS}) a FROM one),
w AS (SELECT name, t, total, round(pow(p, a) / sum(pow(p, a)) OVER (), {DIGITS}) weight FROM src, expo),
b AS (SELECT *, floor(weight * total)::BIGINT budget, greatest(1, (total + {BLOCK_TOKENS - 1}) // {BLOCK_TOKENS}) n_blocks FROM w),
c AS (SELECT base.*, t, weight, budget, n_blocks, budget // t epochs, budget % t rest, unnest(range(0, budget // t + 1)) epoch FROM base JOIN b USING (name)),
k AS (SELECT *, ('0x' || substr(md5('{SEED}|' || epoch || '|' || coalesce(doc_id::VARCHAR, '')), 1, {HASH_DIGITS}))::BIGINT key FROM c),
r AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY name, epoch ORDER BY key, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT before FROM k),
m AS (SELECT *, least(((epoch * t + before) * n_blocks) // budget, n_blocks - 1)::BIGINT block FROM r WHERE epoch < epochs OR before + tokens <= rest)
SELECT doc_id, source, epoch::INTEGER epoch, tokens, weight, block,
       (row_number() OVER (PARTITION BY block ORDER BY key, name, doc_id, epoch, tokens))::INTEGER place FROM m"""


ORACLE_OP5 = _oracle()
