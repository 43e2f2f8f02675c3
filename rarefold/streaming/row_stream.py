"""Feature engineering and scoring of a stream: stateless projections of its rows.

``project`` is the batch operator itself (``features.engineer_milling``, ``score`` below), applied to the streaming DataFrame, so
stream and batch cannot drift apart. Each micro-batch goes to ``rows/batch_id=<id>`` with overwrite: a batch replayed
after a failure rewrites its own files, and progress lives in the checkpoint.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rarefold.operators import contract, explain, linear
from rarefold.spec import DatasetSpec


def score(rows: DataFrame, model: DataFrame, spec: DatasetSpec | None = None, key: str = "row_id") -> DataFrame:
    """(key, margin, score) by a stored coefficient table (``explain.fit_linear``); with ``spec`` of its valid rows only."""
    if spec is not None:
        rows, _ = contract.split(rows, spec)
    return explain.fitted_shap(rows, model, key).select(key, "margin", linear.sigmoid(F.col("margin")).alias("score"))


def start_row_stream(
    spark: SparkSession,
    source_dir: str,
    schema,
    project: Callable[[DataFrame], DataFrame],
    out_root: str,
    glob: str = "*.parquet",
    available_now: bool = True,
    max_files: int | None = None,
):
    """Start (and, for available_now, run to completion) the streaming query; ``project`` must be row-wise."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out_root, "rows", f"batch_id={batch_id}"))

    writer = project(reader.parquet(source_dir)).writeStream.foreachBatch(write_batch)
    writer = writer.option("checkpointLocation", os.path.join(out_root, "_checkpoint"))
    q = writer.trigger(availableNow=True).start() if available_now else writer.start()
    if available_now:
        q.awaitTermination()
    return q
