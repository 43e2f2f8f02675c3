"""Registered queries, sections F (splits) and G (fold-safe preprocessing)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rarefold.operators import bootstrap, prep, resample
from rarefold.plans.common import rounded, valid
from rarefold.plans.oracle_base import OBS, TAGGED, VALID, with_
from rarefold.spec import OBS as SPEC

K = 5
FEATS = list(SPEC.features)


def folded(spark, sf, k=K):
    return resample.stratified_folds(valid(spark, sf), "failure", k=k, seed=42)


def _y():
    return (F.col("failure") == "yes").cast("int")


def q_stratified_folds(spark, sf):
    return folded(spark, sf).select("row_id", "failure", "rep", "fold")


def q_repeated_folds(spark, sf):
    r = resample.repeated_folds(valid(spark, sf), "failure", k=K, repeats=10, seed=42)
    return r.groupBy("rep", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(_y()).cast("long").alias("n_pos"))


def q_nested_folds(spark, sf):
    n = resample.nested_folds(folded(spark, sf), "failure", K, 3, seed=42)
    return n.groupBy("rep", "outer", "inner").agg(F.count(F.lit(1)).alias("n"), F.sum(_y()).cast("long").alias("n_pos"))


def q_stratified_holdout(spark, sf):
    h = resample.stratified_holdout(valid(spark, sf), "failure")
    return h.select("row_id", "failure", "split")


def q_stratified_bootstrap(spark, sf):
    return resample.bootstrap_totals(valid(spark, sf), "failure", n_boot=300, seed=42)


def q_learning_subsets(spark, sf):
    s = resample.learning_subsets(folded(spark, sf), K, seed=42)
    return s.groupBy("rep", "outer", "size_idx", "n_train").agg(F.count(F.lit(1)).alias("n"), F.sum(_y()).cast("long").alias("n_pos"))


def q_fold_expansion(spark, sf):
    e = resample.fold_expansion(folded(spark, sf), K)
    return e.groupBy("rep", "outer", "role").agg(F.count(F.lit(1)).alias("n"), F.sum(_y()).cast("long").alias("n_pos"))


def q_fold_audit(spark, sf):
    return resample.fold_audit(folded(spark, sf), _y())


def q_foldwise_impute(spark, sf):
    return rounded(prep.foldwise_medians(folded(spark, sf), FEATS, K))


def q_foldwise_standardize(spark, sf):
    return rounded(prep.foldwise_standardize(folded(spark, sf), FEATS, K))


def q_naive_impute(spark, sf):
    return rounded(prep.naive_medians(valid(spark, sf), FEATS))


def q_naive_fill(spark, sf):
    return rounded(prep.naive_fill(valid(spark, sf), FEATS, ["row_id"]))


def q_leak_audit(spark, sf):
    return prep.leak_audit(folded(spark, sf), K)


def q_balanced_weights(spark, sf):
    return rounded(prep.balanced_weights(folded(spark, sf), "failure", K))


def q_exact_bootstrap(spark, sf):
    return bootstrap.exact_totals(valid(spark, sf), "failure").select("b", "failure", "n_class", "draws")


QUERIES = {
    "stratified_folds": q_stratified_folds,
    "repeated_folds": q_repeated_folds,
    "nested_folds": q_nested_folds,
    "stratified_holdout": q_stratified_holdout,
    "stratified_bootstrap": q_stratified_bootstrap,
    "exact_bootstrap": q_exact_bootstrap,
    "learning_subsets": q_learning_subsets,
    "fold_expansion": q_fold_expansion,
    "fold_audit": q_fold_audit,
    "foldwise_impute": q_foldwise_impute,
    "foldwise_standardize": q_foldwise_standardize,
    "naive_impute": q_naive_impute,
    "naive_fill": q_naive_fill,
    "leak_audit": q_leak_audit,
    "balanced_weights": q_balanced_weights,
}

FOLDS = """folds AS (
  SELECT *, CASE WHEN failure = 'yes' THEN 1 ELSE 0 END AS y, 0 AS rep,
         CAST((row_number() OVER (PARTITION BY failure ORDER BY md5(concat_ws('|', 42, 0, row_id)), row_id) - 1) % 5 AS INTEGER) AS fold
  FROM valid)"""
EXP = "ex AS (SELECT f.*, CAST(o.outer_ AS INTEGER) AS outer_f, CASE WHEN fold = o.outer_ THEN 'test' ELSE 'train' END AS role FROM folds f, range(5) o(outer_))"
FB = with_(OBS, TAGGED, VALID, FOLDS)
FE = with_(OBS, TAGGED, VALID, FOLDS, EXP)
TRAIN_LONG = """tl AS (
  SELECT rep, outer_f, 'qty' AS attr, qty AS v FROM ex WHERE role = 'train'
  UNION ALL SELECT rep, outer_f, 'price', price FROM ex WHERE role = 'train'
  UNION ALL SELECT rep, outer_f, 'disc', disc FROM ex WHERE role = 'train'
  UNION ALL SELECT rep, outer_f, 'tax', tax FROM ex WHERE role = 'train'
  UNION ALL SELECT rep, outer_f, 'line', CAST(line AS DOUBLE) FROM ex WHERE role = 'train')"""
MEDS = "meds AS (SELECT rep, outer_f, attr, quantile_cont(v, 0.5) AS median, count(v) AS n_fit FROM tl GROUP BY ALL)"

_CDF = resample.poisson1_cdf()
_POIS = "CASE " + " ".join(f"WHEN u < CAST('{c!r}' AS DOUBLE) THEN {j}" for j, c in enumerate(_CDF)) + f" ELSE {len(_CDF)} END"
_FR = resample.LEARNING_FRACTIONS
_SIZE = "CASE " + " ".join(f"WHEN rank0 < floor(CAST('{f!r}' AS DOUBLE) * n_train) THEN {i}" for i, f in enumerate(_FR)) + " END"

ORACLE = {
    "stratified_folds": FB + "SELECT row_id, failure, rep, fold FROM folds",
    "repeated_folds": with_(OBS, TAGGED, VALID)
    + """SELECT rep, fold, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos FROM (
           SELECT CAST(r AS INTEGER) AS rep, CASE WHEN failure = 'yes' THEN 1 ELSE 0 END AS y,
                  CAST((row_number() OVER (PARTITION BY r, failure ORDER BY md5(concat_ws('|', 42, r, row_id)), row_id) - 1) % 5 AS INTEGER) AS fold
           FROM valid, range(10) t(r)) GROUP BY rep, fold""",
    "nested_folds": FE
    + """SELECT rep, outer_f AS outer, "inner", count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos FROM (
           SELECT rep, outer_f, y, CAST((row_number() OVER (PARTITION BY rep, outer_f, failure
                  ORDER BY md5(concat_ws('|', 42, 'inner', rep, outer_f, row_id)), row_id) - 1) % 3 AS INTEGER) AS "inner"
           FROM ex WHERE role = 'train') GROUP BY 1, 2, 3""",
    "stratified_holdout": with_(OBS, TAGGED, VALID)
    + """SELECT row_id, failure, CASE WHEN rank0 < floor(n_c * 7 / 10) THEN 'train' ELSE 'test' END AS split FROM (
           SELECT row_id, failure, row_number() OVER (PARTITION BY failure ORDER BY md5(concat_ws('|', 42, 'holdout', row_id)), row_id) - 1 AS rank0,
                  count(*) OVER (PARTITION BY failure) AS n_c FROM valid)""",
    "exact_bootstrap": with_(OBS, TAGGED, VALID)
    + """SELECT CAST(b AS INTEGER) AS b, failure, count(*) AS n_class, count(*) AS draws FROM valid, range(300) t(b)
         WHERE failure IS NOT NULL GROUP BY b, failure""",
    "stratified_bootstrap": with_(OBS, TAGGED, VALID)
    + f"""SELECT b, failure, count(*) AS n_class, CAST(sum(w) AS BIGINT) AS draws, count(*) FILTER (WHERE w > 0) AS rows_drawn, max(w) AS max_w FROM (
           SELECT CAST(b AS INTEGER) AS b, failure, {_POIS} AS w FROM (
             SELECT b, failure, CAST(('0x' || substr(md5(concat_ws('|', '42', 'boot', CAST(b AS VARCHAR), row_id)), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
             FROM valid, range(300) t(b))) GROUP BY b, failure""",
    "learning_subsets": FE
    + f"""SELECT rep, outer_f AS outer, size_idx, n_train, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos FROM (
           SELECT rep, outer_f, y, n_train, {_SIZE} AS size_idx FROM (
             SELECT rep, outer_f, y, row_number() OVER (PARTITION BY rep, outer_f ORDER BY md5(concat_ws('|', 42, 'lc', row_id)), row_id) - 1 AS rank0,
                    count(*) OVER (PARTITION BY rep, outer_f) AS n_train FROM ex WHERE role = 'train'))
         WHERE size_idx IS NOT NULL GROUP BY ALL""",
    "fold_expansion": FE + "SELECT rep, outer_f AS outer, role, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos FROM ex GROUP BY ALL",
    "fold_audit": FB + "SELECT rep, fold, count(*) AS n_test, CAST(sum(y) AS BIGINT) AS n_pos_test, sum(y) >= 1 AS has_positive FROM folds GROUP BY rep, fold",
    "foldwise_impute": with_(OBS, TAGGED, VALID, FOLDS, EXP, TRAIN_LONG, MEDS)
    + "SELECT rep, outer_f AS outer, attr, round(median, 6) AS median, n_fit FROM meds",
    "foldwise_standardize": with_(OBS, TAGGED, VALID, FOLDS, EXP, TRAIN_LONG, MEDS)
    + """SELECT tl.rep, tl.outer_f AS outer, tl.attr, round(avg(coalesce(v, median)), 6) AS mean,
                round(CASE WHEN stddev_pop(coalesce(v, median)) = 0 THEN 1.0 ELSE stddev_pop(coalesce(v, median)) END, 6) AS sd
         FROM tl JOIN meds ON tl.rep = meds.rep AND tl.outer_f = meds.outer_f AND tl.attr = meds.attr GROUP BY ALL""",
    "naive_impute": with_(OBS, TAGGED, VALID)
    + """SELECT attr, round(quantile_cont(v, 0.5), 6) AS median, count(v) AS n_fit, count(*) FILTER (WHERE v IS NULL) AS filled FROM (
           SELECT 'qty' AS attr, qty AS v FROM valid UNION ALL SELECT 'price', price FROM valid UNION ALL SELECT 'disc', disc FROM valid
           UNION ALL SELECT 'tax', tax FROM valid UNION ALL SELECT 'line', CAST(line AS DOUBLE) FROM valid) GROUP BY attr""",
    "naive_fill": with_(OBS, TAGGED, VALID)
    + """SELECT row_id, round(coalesce(qty, (SELECT quantile_cont(qty, 0.5) FROM valid)), 6) AS qty,
                round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM valid)), 6) AS price,
                round(coalesce(disc, (SELECT quantile_cont(disc, 0.5) FROM valid)), 6) AS disc,
                round(coalesce(tax, (SELECT quantile_cont(tax, 0.5) FROM valid)), 6) AS tax,
                round(coalesce(CAST(line AS DOUBLE), (SELECT quantile_cont(CAST(line AS DOUBLE), 0.5) FROM valid)), 6) AS line FROM valid""",
    "leak_audit": FE
    + """SELECT rep, outer_f AS outer, count(*) FILTER (WHERE role = 'train') AS n_fit, count(*) AS n_total,
                count(*) FILTER (WHERE role = 'train') < count(*) AS leak_free FROM ex GROUP BY ALL""",
    "balanced_weights": FE
    + """SELECT rep, outer_f AS outer, failure, n_c, n_train, round(n_train / (2.0 * n_c), 6) AS weight FROM (
           SELECT rep, outer_f, failure, count(*) AS n_c, CAST(sum(count(*)) OVER (PARTITION BY rep, outer_f) AS BIGINT) AS n_train
           FROM ex WHERE role = 'train' GROUP BY rep, outer_f, failure)""",
}
