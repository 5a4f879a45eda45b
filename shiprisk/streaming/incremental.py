"""Structured Streaming version of the bronze -> silver -> gold refresh.

The original runs the medallion job as a batch over one file.  When raw
order-line files keep arriving, the same cleaning runs per micro-batch:

* the file source reads the new raw CSV files (all columns text, as bronze);
* columns are renamed to snake_case and typed exactly as in batch;
* rows repeated within the batch are dropped, and those whose digest an earlier
  batch has counted (SHA-256 of every column, 32 bytes a row) as well;
* the batch's counts and sums per gold key are a small partial table, and the
  gold version of the batch adds up the partials so far.

So batch n reads its own rows, the digests and the partials: no earlier row is
read again.  Digests, partials and versions are partitions named by the batch
id, and a batch looks only at those of lower numbers; a replayed batch writes
its own partitions anew and changes nothing else.  Nothing is too late and no
state is held in memory; progress lives in the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiprisk import config
from shiprisk.operators import clean
from shiprisk.plans.gold import risk_partials, risk_rates
from shiprisk.schemas import RAW_HEADERS
from shiprisk.session import parallelism
from shiprisk.sources import tables

# Columns of the flat table that the gold table is made of.
RISK_INPUTS = ["shipping_mode", "market", "order_region", "late_delivery_risk", "delay_days"]
RAW_TEXT_SCHEMA = T.StructType([T.StructField(h, T.StringType()) for h in RAW_HEADERS])


def read_raw_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None,
                    encoding: str = config.RAW_ENCODING) -> DataFrame:
    """New raw CSV files under ``path`` as a stream of text rows (by default all
    files present form one micro-batch)."""
    reader = (
        spark.readStream.schema(RAW_TEXT_SCHEMA)
        .option("header", True).option("encoding", encoding)
        .option("quote", '"').option("escape", '"')
    )
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return clean.snake_case_columns(reader.csv(path))


def typed_rows(bronze: DataFrame, types: dict, timestamps: dict) -> DataFrame:
    """Typed rows with nulls filled, before any dedupe."""
    return clean.fill_nulls(clean.parse_timestamps(
        clean.cast_columns(clean.drop_junk(bronze), types), timestamps))


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row; each value is written with its length, and nulls apart from empty texts."""
    texts = [F.col(f"`{c}`").cast("string") for c in columns]
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.length(t).cast("string"), F.lit(":"), t))
             for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def new_rows(batch: DataFrame, digests: DataFrame | None) -> DataFrame:
    """Distinct rows of a batch, with ``digest``, that no earlier batch has counted."""
    rows = batch.withColumn("digest", row_digest(batch.columns)).dropDuplicates(["digest"])
    return rows if digests is None else rows.join(digests.select("digest"), "digest", "left_anti")


def run_gold_refresh(spark: SparkSession, raw_path: str, root: str, checkpoint: str,
                     types: dict, timestamps: dict, table: str = "gold_shipping_risk",
                     files_per_trigger: int | None = None) -> int:
    """Process every file present now (availableNow), one version per batch.

    Versions are runs under ``root/table``; returns their number.
    """
    # A compressed file is read by one task, so the few files of a batch are dealt to all before their rows are typed.
    text = read_raw_stream(spark, raw_path, files_per_trigger).repartition(parallelism(spark), "order_item_id")
    rows = typed_rows(text, types, timestamps)

    def before(name: str, batch_id: int) -> DataFrame | None:
        held = tables.runs(spark, f"{root}/{name}")
        return None if held is None else held.where(F.col(tables.RUN) < batch_id)

    def publish(batch: DataFrame, batch_id: int) -> None:
        fresh = clean.add_delay_days(new_rows(batch, before("digests", batch_id)))
        # One pass over the batch: each new row with its key and what it adds.
        staged = f"{root}/fresh/{tables.RUN}={batch_id}"
        fresh.select("digest", *RISK_INPUTS).write.mode("overwrite").option("compression", tables.CODEC).parquet(staged)
        fresh = spark.read.parquet(staged)
        tables.save_run(fresh.select("digest"), f"{root}/digests", batch_id, replace=True)
        tables.save_run(risk_partials(fresh), f"{root}/partials", batch_id, replace=True)
        partials = tables.runs(spark, f"{root}/partials")
        if partials is not None:
            upto = partials.where(F.col(tables.RUN) <= batch_id)
            tables.save_run(risk_rates(upto), f"{root}/{table}", batch_id, "STREAMING UPDATE", replace=True)

    query = (
        rows.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(publish)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return tables.history(spark, f"{root}/{table}").count()
