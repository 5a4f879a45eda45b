"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiprisk.session import work_dir

#: Words of the contracts: runs of anything but space and \x09-\x0D (Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"

#: Rows in one Arrow batch.  Texts can be long, so batches are kept small.
BATCH_ROWS = 400


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on; returns the session."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fold(col: Column, buckets: int) -> Column:
    """crc32 of a value's decimal text, modulo ``buckets`` (null: the empty text)."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(buckets)


def sample_place(key: Column) -> Column:
    """A row's place in [0, 1): by its key and a row number, so that rows of one key fall apart."""
    name = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.monotonically_increasing_id().cast("string"))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def sampled(df: DataFrame, key: Column, bound: int, rows: int) -> DataFrame:
    """About ``bound`` of ``rows`` rows, chosen by a hash of ``key`` (all, if there are fewer).

    The key alone decides, so the choice is made before any join that brings the texts.
    """
    share = min(1.0, bound / max(rows, 1))
    if share >= 1.0:
        return df
    bits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10)
    return df.filter(bits.cast("double") < F.lit(share * 2.0**32))
