"""A stream's rows equal the batch operator's, over several micro-batches and after a replay."""

import os
import shutil

from pyspark.sql import functions as F

from rarefold.operators import explain, features
from rarefold.spec import OBS
from rarefold.streaming.row_stream import score, start_row_stream


def rows_of(df):
    return sorted(tuple(r[c] for c in sorted(df.columns) if c != "batch_id") for r in df.collect())


def test_scores_of_a_stream_equal_those_of_the_batch(spark, tmp_path):
    df = spark.range(600).select(
        F.concat(F.lit("r"), "id").alias("row_id"), (F.col("id") % 53).cast("double").alias("qty"),
        F.when(F.col("id") % 11 > 0, (F.col("id") * 7 % 101).cast("double")).alias("price"), (F.col("id") % 10 / 100).alias("disc"),
        (F.col("id") % 8 / 100).alias("tax"), (F.col("id") % 7 + 1).cast("int").alias("line"),
        F.when(F.col("id") * 13 % 53 > 40, "yes").otherwise("no").alias("failure"))
    src = str(tmp_path / "in")
    df.repartition(4).write.parquet(src)
    feats = list(OBS.features)
    model = explain.fit_linear(df.withColumn("y", (F.col("failure") == "yes").cast("int")), feats)
    out = str(tmp_path / "out")
    start_row_stream(spark, src, df.schema, lambda s: score(s, model, OBS), out, max_files=1)
    batches = sorted(os.listdir(os.path.join(out, "rows")))
    assert len([b for b in batches if b.startswith("batch_id=")]) == 4
    want = rows_of(score(df, model, OBS))
    assert rows_of(spark.read.parquet(os.path.join(out, "rows"))) == want and 0 < len(want) < 600
    # the last batch's commit is lost: it is written again, not twice
    commits = os.path.join(out, "_checkpoint", "commits")
    for name in ("3", ".3.crc"):
        if os.path.exists(os.path.join(commits, name)):
            shutil.copy(os.path.join(commits, name), str(tmp_path))
            os.remove(os.path.join(commits, name))
    start_row_stream(spark, src, df.schema, lambda s: score(s, model, OBS), out, max_files=1)
    assert rows_of(spark.read.parquet(os.path.join(out, "rows"))) == want


def test_engineered_features_of_a_stream_equal_those_of_the_batch(spark, tmp_path):
    df = spark.range(200).select(
        F.col("id").alias("row_id"), F.element_at(F.array(F.lit("L"), F.lit("M"), F.lit("H"), F.lit(None)), (F.col("id") % 4 + 1).cast("int")).alias("type"),
        (F.col("id") + 295.5).alias("air_temperature_k"), (F.col("id") + 305.0).alias("process_temperature_k"), (F.col("id") * 9).cast("int").alias("rotational_speed_rpm"),
        F.when(F.col("id") % 5 > 0, F.col("id") / 3).alias("torque_nm"), (F.col("id") % 250).cast("int").alias("tool_wear_min"), (F.col("id") % 2).cast("int").alias("machine_failure"))
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.repartition(3).write.parquet(src)

    start_row_stream(spark, src, df.schema, features.engineer_milling, out, max_files=2)
    got, want = spark.read.parquet(os.path.join(out, "rows")), features.engineer_milling(df)
    assert sorted(map(str, rows_of(got))) == sorted(map(str, rows_of(want))) and {"power_w", "temp_delta_k", "wear_x_torque"} <= set(got.columns)
