"""Registered queries, section A (sources, sinks) and the streaming contract (rows-only)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from rarefold.operators import contract, explain, profile
from rarefold.plans.common import obs, rounded, valid
from rarefold.plans.oracle_base import OBS, TAGGED, with_
from rarefold.sources import bindings, io
from rarefold.spec import OBS as SPEC
from rarefold.streaming.contract_stream import start_contract_stream
from rarefold.streaming.row_stream import score, start_row_stream


def q_scan_contract_csv(spark, sf):
    """A1: observations written as CSV text, scanned back with the declared schema + contract."""
    o = obs(spark, sf).select("row_id", *SPEC.columns)
    path = io.write_csv(o, io.new_path(spark, "obs-csv"))
    typed, types = io.scan_csv(spark, path, SPEC)
    summary = contract.contract_summary(contract.tag(typed, SPEC))
    return summary.crossJoin(types.agg(F.count(F.lit(1)).alias("type_violations")))


def dirty_text(spark, sf):
    """The observations as text with bad cells planted by a fixed rule on the row's md5 key."""
    o = obs(spark, sf).select("row_id", *[F.col(c).cast("string").alias(c) for c in SPEC.columns])
    for col, at, text in PLANTED:
        o = o.withColumn(col, F.when(F.substring("row_id", at, 2) == "0a", F.lit(text)).otherwise(F.col(col)))
    return o


#: Column, place of the two hex digits of row_id that must be ``0a``, and the text planted there.
PLANTED = (("qty", 1, "n/a"), ("price", 3, "12,5"), ("line", 5, "two"))


def q_type_violations(spark, sf):
    """B2: cells of a dirty CSV that aren't of their declared type."""
    _, types = io.scan_csv(spark, io.write_csv(dirty_text(spark, sf), io.new_path(spark, "dirty-csv")), SPEC)
    return types


def q_scan_contract_dirty(spark, sf):
    """A1 + B7 on dirty text: rows with a bad cell are quarantined, never passed as nulls."""
    typed, _ = io.scan_csv(spark, io.write_csv(dirty_text(spark, sf), io.new_path(spark, "dirty-csv")), SPEC)
    return contract.contract_summary(contract.tag(typed, SPEC))


def q_quarantine_sink(spark, sf):
    """A5: quarantined rows appended to the partitioned sink and read back (partition pruned)."""
    _, bad = contract.split(obs(spark, sf), SPEC)
    root = io.new_path(spark, "quarantine")
    written = io.quarantine_sink(bad, SPEC.name, root)
    back = io.read_quarantine(spark, root, SPEC.name)
    return back.groupBy("dataset", "quarantine_reason").agg(F.count(F.lit(1)).alias("n")).withColumn("written", F.lit(written))


def _report_rows(spark, sf):
    from rarefold.plans.common import valid

    v = valid(spark, sf)
    bal = profile.class_balance(v, "failure", "yes")
    desc = profile.descriptive_table(v, SPEC.numeric_attributes())
    a = io.to_report_rows(bal, SPEC.name, "eda", None, ["n", "n_positive", "prevalence", "majority_accuracy"])
    b = io.to_report_rows(desc, SPEC.name, "eda", "attr", ["n", "nulls", "min", "max", "mean", "median", "sd", "skew"])
    return a.unionByName(b)


def q_report_mart_json(spark, sf):
    """Report rows serialised as JSON text (one object per row)."""
    rows = _report_rows(spark, sf)
    path = io.write_report(rows, io.new_path(spark, "report"))
    return spark.read.text(path)


def q_report_readback(spark, sf):
    """Written report read back; a missing report reads as empty (degrades, never fails)."""
    path = io.write_report(_report_rows(spark, sf), io.new_path(spark, "report"))
    back = io.read_report(spark, path)
    missing = io.read_report(spark, os.path.join(path, "does-not-exist"))
    return back.unionByName(missing)


def _observations(stream):
    return stream.select(
        bindings.row_key().alias("row_id"),
        F.col("l_quantity").alias("qty"),
        F.when((F.col("l_linenumber") == 7) & (F.col("l_discount") == 0), F.lit(None).cast("double")).otherwise(F.col("l_extendedprice")).alias("price"),
        F.col("l_discount").alias("disc"),
        F.col("l_tax").alias("tax"),
        F.col("l_linenumber").cast("int").alias("line"),
        bindings.failure_label().alias("failure"),
    )


def q_stream_contract(spark, sf):
    """Streaming: lineitem read as a stream, contract applied per micro-batch, sinks read back."""
    schema = bindings.table(spark, sf, "lineitem").schema
    out = io.new_path(spark, "stream")

    start_contract_stream(spark, sf, schema, _observations, SPEC, out, glob="lineitem.parquet")
    valid = spark.read.parquet(os.path.join(out, "valid")).agg(F.count(F.lit(1)).alias("n_valid"))
    bad = spark.read.parquet(os.path.join(out, "quarantine")).agg(F.count(F.lit(1)).alias("n_quarantined"))
    return valid.crossJoin(bad)


def q_stream_scores(spark, sf):
    """Streaming: valid rows of lineitem scored by the stored coefficients of the fitted logistic model."""
    rows = valid(spark, sf).withColumn("y", (F.col("failure") == "yes").cast("int")).select("row_id", "y", *SPEC.features)
    stored, out = io.new_path(spark, "model"), io.new_path(spark, "scores")
    explain.fit_linear(rows, list(SPEC.features)).write.mode("overwrite").parquet(stored)
    model = spark.read.parquet(stored)
    schema = bindings.table(spark, sf, "lineitem").schema
    start_row_stream(spark, sf, schema, lambda s: score(_observations(s), model, SPEC), out, glob="lineitem.parquet")
    return rounded(spark.read.parquet(os.path.join(out, "rows")).select("row_id", "margin", "score"))


QUERIES = {
    "stream_scores": q_stream_scores,
    "scan_contract_csv": q_scan_contract_csv,
    "type_violations": q_type_violations,
    "scan_contract_dirty": q_scan_contract_dirty,
    "quarantine_sink": q_quarantine_sink,
    "report_mart_json": q_report_mart_json,
    "report_readback": q_report_readback,
    "stream_contract": q_stream_contract,
}
_BAD = {c: f"substr(row_id, {at}, 2) = '0a'" for c, at, _ in PLANTED}
ORACLE = {
    "type_violations": with_(OBS) + " UNION ALL ".join(
        f"""SELECT row_id, '{c}' AS "column", 'dtype(''{'int' if c == 'line' else 'double'}'')' AS "check", '{text}' AS value FROM obs WHERE {_BAD[c]}"""
        for c, _, text in PLANTED
    ),
    "scan_contract_dirty": with_(OBS, TAGGED)
    + f"""SELECT count(*) AS n_read, count(*) FILTER (WHERE ok) AS n_valid, count(*) FILTER (WHERE NOT ok) AS n_quarantined
          FROM (SELECT quarantine_reason IS NULL AND NOT ({" OR ".join(_BAD.values())}) AS ok FROM tagged)""",
}
