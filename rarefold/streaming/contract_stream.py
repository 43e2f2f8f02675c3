"""Streaming contract: the row-wise contract on a streaming DataFrame.

``readStream`` (declared schema) -> derive observations -> ``foreachBatch`` splits each
micro-batch into valid rows and quarantined rows with reasons.  Each batch is written
to ``.../batch_id=<id>`` with overwrite, so a replayed batch after a failure rewrites
the same files (exactly-once output per batch); progress lives in the checkpoint.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from rarefold.operators import contract
from rarefold.spec import DatasetSpec


def start_contract_stream(
    spark: SparkSession,
    source_dir: str,
    schema,
    derive,
    spec: DatasetSpec,
    out_root: str,
    glob: str = "*.parquet",
    available_now: bool = True,
    max_files: int | None = None,
):
    """Start (and, for available_now, run to completion) the streaming contract query."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.parquet(source_dir)
    obs = derive(stream)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read by both writes
        valid, bad = contract.split(batch, spec)
        valid.write.mode("overwrite").parquet(os.path.join(out_root, "valid", f"batch_id={batch_id}"))
        bad.write.mode("overwrite").parquet(os.path.join(out_root, "quarantine", f"batch_id={batch_id}"))
        batch.unpersist()

    writer = obs.writeStream.foreachBatch(write_batch).option("checkpointLocation", os.path.join(out_root, "_checkpoint"))
    q = writer.trigger(availableNow=True).start() if available_now else writer.start()
    if available_now:
        q.awaitTermination()
    return q
