"""The whole bronze -> silver -> gold job over one raw order-line file.

Each layer is written once as a catalog table and the next layer reads it back,
so nothing is recomputed across layers (the cleaned frame feeds seven tables)
and a lost executor only re-reads Parquet.  Rows are counted while they are
written.  The flat table and the six relational tables depend only on the
cleaned rows and are submitted together, and so are the gold tables.  Gold
tables are runs: every refresh adds a version that stays readable.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from shiprisk import config
from shiprisk.operators import clean
from shiprisk.operators.normalize import normalize
from shiprisk.plans.gold import build_gold
from shiprisk.sources import csv_io, tables

# FIXED VALUES: table names of the layers (the relational orders table is
# "order headers" because the flat table already holds the name).
BRONZE = "bronze_supply_chain"
CLEANED = "silver_cleaned"
FLAT = "silver_orders"
SILVER_NAMES = {
    "categories": "silver_categories", "products": "silver_products",
    "customers": "silver_customers", "orders": "silver_order_headers",
    "order_items": "silver_order_items", "shipments": "silver_shipments",
}


def _together(jobs: list[Callable[[], tuple]], concurrency: int) -> list[tuple]:
    """Results of independent Spark jobs, submitted from a few driver threads."""
    with ThreadPoolExecutor(max_workers=max(1, concurrency)) as pool:
        return [future.result() for future in [pool.submit(job) for job in jobs]]


def run_medallion(spark: SparkSession, raw_path: str, root: str, cutoff: str = config.DATA_CUTOFF,
                  types: dict | None = None, timestamps: dict | None = None,
                  encoding: str = config.RAW_ENCODING, concurrency: int = 4) -> DataFrame:
    """Run every layer; returns (table_name, version, n_rows) of what was written.

    Bronze and silver are replaced (their version is that of this refresh's gold).
    """
    run = tables.latest_run(spark, f"{root}/gold_shipping_risk")
    run = 0 if run is None else int(run) + 1

    def save(df: DataFrame, name: str) -> tuple[str, int, int]:
        return name, run, tables.save_table(df, name, f"{root}/{name}-{run}")

    def save_gold(df: DataFrame, name: str) -> tuple[str, int, int]:
        tables.save_run(df, f"{root}/{name}", run)
        return name, run, tables.read_run(spark, f"{root}/{name}", run).count()  # footers of a small table

    written = [save(clean.snake_case_columns(csv_io.read_raw_csv(spark, raw_path, encoding)), BRONZE)]
    # Typing the text costs more than shuffling the typed rows, so these are made once.
    cleaned = clean.clean(tables.read_table(spark, BRONZE), types, timestamps, digests_first=False)
    written.append(save(cleaned, CLEANED))
    frames = normalize(tables.read_table(spark, CLEANED))
    silver = [(FLAT, frames.flat)] + [(SILVER_NAMES[name], df) for name, df in frames.as_dict().items()]
    written += _together([lambda n=n, d=d: save(d, n) for n, d in silver], concurrency)
    gold = build_gold(tables.read_table(spark, FLAT), cutoff)
    written += _together([lambda n=n, d=d: save_gold(d, n) for n, d in gold.items()], concurrency)
    return spark.createDataFrame(written, "table_name string, version bigint, n_rows bigint")  # a row a table
