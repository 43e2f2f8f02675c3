"""A: scans and sinks.

* CSV scan with a declared schema (never inferred): every column is read as text
  first so that type violations can be reported per cell; typed columns are then
  ``try_cast`` so a bad cell becomes a reported violation instead of a failed job.
* Quarantine sink: append-only parquet partitioned by (dataset, run_date); written
  only when there is at least one bad row; never deletes, never imputes.
* Report mart: long rows (dataset, section, entity, metric, value) serialised with
  ``to_json(struct(...))``; read back with ``spark.read.json``; a missing report
  path reads as an empty frame so downstream sections degrade instead of failing.

All paths live under the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rarefold.operators import contract
from rarefold.session import scratch_path
from rarefold.spec import DatasetSpec

REPORT_SCHEMA = "dataset string, section string, entity string, metric string, value double"


def new_path(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


#: Name for the raw text of a row whose number of cells isn't the header's.
CORRUPT = "_corrupt_row"


def scan_csv(spark: SparkSession, path: str, spec: DatasetSpec, key: str | None = "row_id") -> tuple[DataFrame, DataFrame]:
    """A1 + B2: (typed frame with ``type_reason``, per-cell type violations).  Structural problems raise first.

    Columns are taken by header name, in any order. A cell that isn't of its type, and a row with too few or
    too many cells, become a reason in ``type_reason``: ``contract.split`` quarantines them, they never pass
    as nulls. ``key=None``: rows get their 0-based position as ``row_id``."""
    names = spark.read.option("header", True).csv(path).columns
    held = spark.read.option("header", True).csv(path)
    contract.check_structure(held, spec, allow=(key,) if key else (), check_types=False)
    text = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField(CORRUPT, T.StringType())])
    raw = spark.read.schema(text).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    if key is None:
        raw, key = _numbered(raw), "row_id"
    contract.assert_columns_parse(raw, spec)
    types = contract.type_violations(raw, spec, key)
    parts = [F.when(F.col(CORRUPT).isNotNull(), F.lit(f"row incumple cells({len(names)})"))]
    for f in spec.fields:
        c = F.trim(F.col(f.name))
        if not isinstance(f.dtype, T.StringType):
            parts.append(F.when(c.isNotNull() & c.try_cast(f.dtype).isNull(), F.concat(F.lit(f"{f.name}='"), F.col(f.name), F.lit(f"' incumple dtype('{f.dtype.simpleString()}')"))))
    reason = F.nullif(F.concat_ws("; ", *parts), F.lit("")).alias(contract.TYPE_REASON)
    cells = [(F.col(f.name) if isinstance(f.dtype, T.StringType) else F.trim(F.col(f.name)).try_cast(f.dtype)).alias(f.name) for f in spec.fields]
    return raw.select(key, *cells, reason), types


def _numbered(raw: DataFrame) -> DataFrame:
    """``row_id``: position in the file, from each partition's row count and the order inside it."""
    marked = raw.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    sizes = marked.groupBy(part.alias("_part")).count().collect()  # one row a partition
    starts, at = [], 0
    for r in sorted(sizes, key=lambda r: r["_part"]):
        starts.append((r["_part"], at))
        at += r["count"]
    first = raw.sparkSession.createDataFrame(starts, "_part long, _first long")
    out = marked.withColumn("_part", part.cast("long")).join(F.broadcast(first), "_part")
    return out.withColumn("row_id", (F.col("_first") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).cast("string")).drop("_id", "_part", "_first")


def quarantine_sink(bad: DataFrame, dataset: str, root: str, run_id: str | None = None) -> int:
    """A5: quarantined rows with a UTC run stamp, partitioned by (dataset, run_date, run_id); rows written.

    One pass: the count is observed while writing. A replay with the same ``run_id`` and date overwrites its own
    rows, so nothing is doubled; no bad row means no folder for the run."""
    out = bad.withColumn("run_ts", F.current_timestamp()).withColumn("dataset", F.lit(dataset)).withColumn(
        "run_date", F.date_format(F.col("run_ts"), "yyyyMMdd")
    ).withColumn("run_id", F.lit(run_id or uuid.uuid4().hex))
    seen = Observation()
    out.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "run_date", "run_id").parquet(root)
    return int(seen.get["n"])


def read_quarantine(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """Partition-pruned read of one dataset's quarantine."""
    return spark.read.parquet(root).filter(F.col("dataset") == dataset)


def to_report_rows(df: DataFrame, dataset: str, section: str, entity: str | None, metrics: list[str]) -> DataFrame:
    """Long report-mart rows from a (small) result table; NaN becomes null."""
    ent = F.col(entity).cast("string") if entity else F.lit(None).cast("string")
    long = df.select(ent.alias("entity"), *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(["entity"], metrics, "metric", "value")
    return long.select(F.lit(dataset).alias("dataset"), F.lit(section).alias("section"), "entity", "metric",
                       F.when(F.isnan("value"), F.lit(None)).otherwise(F.col("value")).alias("value"))


def write_report(rows: DataFrame, path: str) -> str:
    """One JSON object per row, nulls kept."""
    j = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
    j.write.mode("overwrite").text(path)
    return path


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Read the report mart back; a missing path gives an empty frame."""
    try:
        return spark.read.schema(REPORT_SCHEMA).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], REPORT_SCHEMA)
