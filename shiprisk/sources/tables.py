"""Catalog tables (S3, S4) and runs kept side by side.

``save_table`` replaces a catalog table, data and schema; the rows written are
counted on their way (``DataFrame.observe``), so nothing is read again.

``save_run`` adds a run to a Parquet folder partitioned by ``run_id``.  A run is
written once: Spark's committer moves its partition into place when the job
ends, and a second run of the same number is refused (``replace`` lets the replay
of a failed or repeated batch overwrite its own partition and nothing else).
History is an aggregate over the runs and a version a partition filter, so both
are plain DataFrames and nothing but the rows themselves is stored.

Defined results: a table or run without rows counts 0 rows; a run without rows
has no partition, so history doesn't list it; a run whose columns or types
differ from the table's is refused (``save_table`` replaces schemas).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RUN = "run_id"
OPERATION, WRITTEN_AT = "run_operation", "run_written_at"
# Tables and runs are written once and kept.
CODEC = "zstd"


def save_table(df: DataFrame, name: str, path: str | None = None) -> int:
    """S3: replace table ``name`` (managed, or external at ``path``); returns the rows written."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("n_rows")).write.mode("overwrite").format("parquet").option("compression", CODEC)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return int(seen.get.get("n_rows", 0))


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """The table's rows."""
    return spark.table(name)


def runs(spark: SparkSession, root: str) -> DataFrame | None:
    """All runs under ``root`` with their run columns, None before the first one."""
    try:
        return spark.read.option("basePath", root).parquet(root)
    except AnalysisException as exc:
        if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def latest_run(spark: SparkSession, root: str) -> int | None:
    held = runs(spark, root)
    return None if held is None else held.agg(F.max(RUN).alias("r")).first()["r"]


def save_run(df: DataFrame, root: str, run_id: int | None = None, operation: str = "WRITE",
             replace: bool = False) -> int:
    """Add a run (by default the next number) to the runs under ``root``; returns its number."""
    spark = df.sparkSession
    clash = {RUN, OPERATION, WRITTEN_AT} & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are the run's own")
    held = runs(spark, root)
    if held is not None:
        own = {f.name: f.dataType for f in held.schema.fields if f.name not in (RUN, OPERATION, WRITTEN_AT)}
        if own != {f.name: f.dataType for f in df.schema.fields}:
            raise ValueError("a run has the columns of the runs before; save_table replaces a schema")
    if run_id is None:
        last = latest_run(spark, root)
        run_id = 0 if last is None else int(last) + 1
    elif held is not None and not replace and not held.where(F.col(RUN) == run_id).isEmpty():
        raise ValueError(f"run {run_id} is written")
    stamped = df.withColumns({OPERATION: F.lit(operation), WRITTEN_AT: F.current_timestamp().cast("timestamp_ntz"),
                              RUN: F.lit(run_id).cast("bigint")})
    # Only the partitions written are replaced, and they appear when the job commits.
    stamped.write.partitionBy(RUN).mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
        "compression", CODEC).parquet(root)
    return run_id


def history(spark: SparkSession, root: str) -> DataFrame:
    """One row a run: version, committed_at, operation, n_rows."""
    held = runs(spark, root)
    if held is None:
        return spark.createDataFrame([], "version bigint, committed_at timestamp_ntz, operation string, n_rows bigint")
    return held.groupBy(F.col(RUN).cast("bigint").alias("version")).agg(
        F.max(WRITTEN_AT).alias("committed_at"), F.max(OPERATION).alias("operation"),
        F.count(F.lit(1)).alias("n_rows"))


def read_run(spark: SparkSession, root: str, run_id: int | None = None) -> DataFrame:
    """The rows of one run (by default the latest), without the run columns."""
    held = runs(spark, root)
    run_id = latest_run(spark, root) if run_id is None else run_id
    if held is None or run_id is None or held.where(F.col(RUN) == run_id).isEmpty():
        raise ValueError(f"no run {run_id} under {root}")
    return held.where(F.col(RUN) == run_id).drop(RUN, OPERATION, WRITTEN_AT)
