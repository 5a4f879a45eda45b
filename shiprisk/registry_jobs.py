"""Registered source, cleaning, audit, join and snapshot jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiprisk.functions.calendar import MONTH_NO
from shiprisk.model import SupplyTables
from shiprisk.operators import audit, clean
from shiprisk.operators.normalize import table_from_cleaned
from shiprisk.plans import gold
from shiprisk.schemas import (
    DEDUPED_TABLES, INT_COLUMNS, NUMERIC_COLUMNS, PRIMARY_KEYS, RAW_HEADERS, TABLE_COLUMNS, contract,
)
from shiprisk.session import apply_defaults, work_dir
from shiprisk.sources import csv_io, silver, tables, testbed
from shiprisk import config

CUTOFF = config.TESTBED_CUTOFF
BRONZE_TS = {"order_date_dateorders": "order_date", "shipping_date_dateorders": "shipping_date"}


def edge(df: DataFrame) -> DataFrame:
    """Hand decimals out as DOUBLE (exact values, engine-neutral type)."""
    return df.select(*[
        F.col(f"`{f.name}`").cast("double").alias(f.name)
        if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def _typed(s: SparkSession, d: str) -> DataFrame:
    apply_defaults(s)
    testbed.plan_shuffles(s, d)
    return testbed.typed_rows(s, d)


def _raw(s: SparkSession, d: str) -> DataFrame:
    """The raw rows; every job reads them once, and only the columns it needs."""
    apply_defaults(s)
    testbed.plan_shuffles(s, d)
    return testbed.raw_rows(s, d)


def _bronze_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def csv_bronze_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Raw latin-1 CSV -> bronze -> silver flat, compared with the mapping."""
    raw = _raw(s, d)
    path = work_dir(s, "raw-csv")
    csv_io.write_raw_csv(raw, path, compression="gzip")
    bronze = clean.snake_case_columns(csv_io.read_raw_csv(s, path))
    types = {c: t for c, t in zip(raw.columns, raw.schema.fields)}
    cast_types = {c: f.dataType for c, f in types.items()
                  if not isinstance(f.dataType, (T.StringType, T.TimestampNTZType))}
    silver = clean.drop_pii(clean.clean(bronze, cast_types, BRONZE_TS, digests_first=False))
    return edge(silver.select(*testbed.FLAT_ORDER))


def silver_flat(s: SparkSession, d: str) -> DataFrame:
    return edge(clean.drop_pii(clean.clean_typed(_raw(s, d), digests_first=False)).select(*testbed.FLAT_ORDER))


def snake_case_columns(s: SparkSession, d: str) -> DataFrame:
    return edge(clean.snake_case_columns(_typed(s, d).toDF(*RAW_HEADERS)))


def drop_columns(s: SparkSession, d: str) -> DataFrame:
    return edge(clean.drop_junk(_typed(s, d)))


def cast_columns(s: SparkSession, d: str) -> DataFrame:
    typed = _typed(s, d)
    types = {f.name: f.dataType for f in typed.schema.fields}
    return edge(clean.cast_columns(_bronze_text(typed), types, on_error="fail"))


def try_cast_columns(s: SparkSession, d: str) -> DataFrame:
    """The original cast lists on text: non-numeric keys become NULL."""
    out = clean.cast_columns(_bronze_text(_typed(s, d)), clean.default_types(), on_error="null")
    return edge(out.select(*INT_COLUMNS, *NUMERIC_COLUMNS))


def parse_timestamps(s: SparkSession, d: str) -> DataFrame:
    typed = _typed(s, d)
    text = typed.select(
        "order_item_id",
        F.date_format("order_date", config.RAW_TIMESTAMP_FORMAT).alias("order_date_dateorders"),
        F.date_format("shipping_date", config.RAW_TIMESTAMP_FORMAT).alias("shipping_date_dateorders"))
    return clean.parse_timestamps(text, BRONZE_TS)


def fill_nulls(s: SparkSession, d: str) -> DataFrame:
    return clean.fill_nulls(_typed(s, d)).select(
        "order_item_id", "order_zipcode", "customer_lname", "customer_zipcode")


def drop_exact_duplicates(s: SparkSession, d: str) -> DataFrame:
    return edge(clean.drop_exact_duplicates(_raw(s, d), digests_first=False))


def dedupe_counts(s: SparkSession, d: str) -> DataFrame:
    return clean.dedupe_report(_raw(s, d))


def delay_days(s: SparkSession, d: str) -> DataFrame:
    flat = clean.add_delay_days(_typed(s, d).drop("delay_days"))
    return flat.select("order_item_id", "days_for_shipping_real", "days_for_shipment_scheduled",
                       "delay_days")


def dedupe_by_key(s: SparkSession, d: str) -> DataFrame:
    rows = _raw(s, d).select("order_id", "order_item_id", "order_status", "market")
    return clean.dedupe_by_key(rows, "order_id", "order_item_id")


def _dim(table: str):
    """A table of the cleaned rows.  Those with one row per key need no row
    dedupe first, so only their own columns are read and aggregated."""
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = _raw(s, d)
        cleaned = clean.filled(rows) if table in DEDUPED_TABLES else clean.clean_typed(rows, digests_first=False)
        return edge(table_from_cleaned(cleaned, table))
    return run


def profile_columns(s: SparkSession, d: str) -> DataFrame:
    apply_defaults(s)
    return audit.profile_columns(silver.testbed_silver(s, d).flat.drop(MONTH_NO))


def null_counts(s: SparkSession, d: str) -> DataFrame:
    return audit.null_counts(_typed(s, d))


def null_total(s: SparkSession, d: str) -> DataFrame:
    return audit.null_total(_typed(s, d))


def duplicate_row_count(s: SparkSession, d: str) -> DataFrame:
    return audit.duplicate_row_count(_raw(s, d))


def table_row_counts(s: SparkSession, d: str) -> DataFrame:
    apply_defaults(s)
    return audit.table_row_counts(_rel(s, d).as_dict())


def pk_violations(s: SparkSession, d: str) -> DataFrame:
    """A5: null and repeated keys of the six tables."""
    return audit.pk_report(_rel(s, d))


def raw_key_repeats(s: SparkSession, d: str) -> DataFrame:
    """How often the six tables' keys occur in the raw rows, before any dedupe."""
    filled = clean.fill_nulls(_raw(s, d))
    keys = {t: dict(pairs)[PRIMARY_KEYS[t]] for t, pairs in TABLE_COLUMNS.items()}
    return audit.pk_report_projected(filled, keys)


def fk_orphans(s: SparkSession, d: str) -> DataFrame:
    apply_defaults(s)
    return audit.fk_report(_rel(s, d))


def reconcile_flat_vs_relational(s: SparkSession, d: str) -> DataFrame:
    apply_defaults(s)
    t = silver.testbed_silver(s, d)

    def by_mode_market(df: DataFrame) -> DataFrame:
        return df.groupBy("shipping_mode", "market").agg(
            F.count(F.lit(1)).alias("total_shipments"),
            F.sum("late_delivery_risk").cast("bigint").alias("late_shipments"))

    flat = by_mode_market(t.star("order_items", "shipments", "orders"))
    rel = by_mode_market(t.relational().star("order_items", "shipments", "orders"))
    return audit.reconcile(flat, rel, ["shipping_mode", "market"],
                           ["total_shipments", "late_shipments"], ("flat", "rel"))


def _rel(s: SparkSession, d: str) -> SupplyTables:
    """Relational silver tables without the flat shortcut."""
    apply_defaults(s)
    return silver.testbed_silver(s, d).relational()


JOIN_COLUMNS = {
    "join_items_orders": (("order_items", "orders"),
                          ["order_item_id", "order_id", "customer_id", "order_date", "market",
                           "order_region", "sales"]),
    "join_items_shipments": (("order_items", "shipments"),
                             ["order_item_id", "order_id", "shipping_mode", "late_delivery_risk",
                              "quantity", "sales"]),
    "join_items_products": (("order_items", "products"),
                            ["order_item_id", "product_card_id", "product_name", "category_id",
                             "sales"]),
    "join_products_categories": (("products", "categories"),
                                 ["product_card_id", "product_name", "category_id", "category_name",
                                  "department_name"]),
    "join_orders_customers": (("orders", "customers"),
                              ["order_id", "customer_id", "segment", "country", "order_country",
                               "market"]),
    "star_join": (tuple(TABLE_COLUMNS),
                  ["order_item_id", "order_id", "customer_id", "product_card_id", "category_id",
                   "category_name", "department_name", "segment", "shipping_mode", "market",
                   "order_region", "sales", "profit_per_order", "late_delivery_risk"]),
}


def _join(name: str):
    parts, cols = JOIN_COLUMNS[name]
    return lambda s, d: edge(_rel(s, d).star(*parts).select(*cols))


def save_table_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Replaced by a table of another schema, then by the gold table again."""
    apply_defaults(s)
    root, flat = work_dir(s, "tables"), silver.testbed_silver(s, d).flat
    name = "gold_shipping_risk_saved"
    tables.save_table(gold.gold_category_profitability(flat, CUTOFF), name, f"{root}/first")
    tables.save_table(gold.gold_shipping_risk(flat), name, f"{root}/second")
    return tables.read_table(s, name)


def table_history(s: SparkSession, d: str) -> DataFrame:
    """Two runs of the same job: two versions with the same row count."""
    apply_defaults(s)
    root = work_dir(s, "gold-runs")
    for _ in range(2):
        tables.save_run(gold.gold_shipping_risk(silver.testbed_silver(s, d).flat), root)
    return tables.history(s, root).select("version", "operation", "n_rows")


def read_version(s: SparkSession, d: str) -> DataFrame:
    """Version 0 (before-cutoff revenue) stays readable after a second run."""
    apply_defaults(s)
    root, flat = work_dir(s, "gold-runs"), silver.testbed_silver(s, d).flat
    tables.save_run(gold.gold_monthly_revenue_by_market(flat, CUTOFF), root)
    tables.save_run(gold.gold_monthly_revenue_by_market(flat, "9999-01-01"), root)
    return tables.read_run(s, root, 0)


def _export(s: SparkSession, d: str) -> tuple[str, dict[str, DataFrame]]:
    """The six tables as CSV.  Each is written plainly before, and items and shipments as one projection of the
    flat rows: the buckets and months of the silver layer would cost two more shuffles of all lines."""
    apply_defaults(s)
    testbed.plan_shuffles(s, d)
    root = work_dir(s, "export")

    def written(name: str, df: DataFrame) -> DataFrame:
        df.write.option("compression", silver.CODEC).parquet(f"{root}/tables/{name}")
        return s.read.parquet(f"{root}/tables/{name}")

    dims = testbed.tables(s, d, with_flat=False).as_dict()
    columns = dict.fromkeys(src for t in silver.FLAT_PROJECTIONS for _, src in TABLE_COLUMNS[t])
    lines = written("lines", testbed.flat(s, d).select(*columns))
    t = {n: clean.project_rename(lines, TABLE_COLUMNS[n]) if n in silver.FLAT_PROJECTIONS else written(n, df)
         for n, df in dims.items()}
    csv_io.export_csv(t, f"{root}/csv", "gzip")
    return f"{root}/csv", t


def normalized_csv_export(s: SparkSession, d: str) -> DataFrame:
    """Export the six tables, load them back typed, count rows and columns."""
    root, t = _export(s, d)
    parts = []
    for name, df in t.items():
        loaded = csv_io.load_typed_csv(s, f"{root}/{name}", df.schema)
        parts.append(loaded.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(loaded.columns)).alias("n_cols")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def typed_csv_load(s: SparkSession, d: str) -> DataFrame:
    t = _rel(s, d)
    root = work_dir(s, "export")
    csv_io.export_csv({"order_items": t.order_items}, root, "gzip")
    return edge(csv_io.load_typed_csv(s, f"{root}/order_items", t.order_items.schema))


def _broken_export(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Order items exported as text with a bad number, a missing key or a missing value in some lines, loaded checked."""
    items = _rel(s, d).order_items
    key = PRIMARY_KEYS["order_items"]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    broken = {"quantity": F.when(F.col("order_id") % 97 == 0, F.concat(F.lit("x"), text("quantity"))).otherwise(text("quantity")),
              key: F.when(F.col("order_id") % 89 == 1, F.lit("")).otherwise(text(key))}
    values = [broken.get(c, text(c)) for c in items.columns]
    last = F.when(F.col("order_id") % 83 == 2, F.concat_ws(",", *values[:-1])).otherwise(F.concat_ws(",", *values))
    root = work_dir(s, "broken")
    items.select(last.alias("value")).write.text(f"{root}/text", compression="gzip")
    schema = T.StructType([T.StructField(f.name, f.dataType, f.name != key) for f in items.schema.fields])
    good, bad = csv_io.load_checked(s, f"{root}/text", "order_items", schema, f"{root}/checked", header=False)
    return good, bad


def quarantined_rows(s: SparkSession, d: str) -> DataFrame:
    return _broken_export(s, d)[1]


def quarantine_passed(s: SparkSession, d: str) -> DataFrame:
    """The rows that pass the checked load, typed."""
    return edge(_broken_export(s, d)[0])


def contract_violations(s: SparkSession, d: str) -> DataFrame:
    """Six DDL contracts checked on the text of the raw rows, one pass."""
    bronze = _bronze_text(_raw(s, d))
    cols, fields = [], []
    for table, pairs in TABLE_COLUMNS.items():
        c = contract(table)
        for out, src in pairs:
            name = f"{table}__{out}"
            cols.append(F.col(src).alias(name))
            f = c[out]
            fields.append(T.StructField(name, f.dataType, f.nullable))
    _, violations = audit.conform(bronze.select(*cols), T.StructType(fields))
    parts = F.split(F.col("column_name"), "__")
    return violations.select(parts.getItem(0).alias("table_name"),
                             parts.getItem(1).alias("column_name"), "reason", "n_rows")


def queries() -> dict:
    out = {
        "csv_bronze_roundtrip": csv_bronze_roundtrip,
        "snake_case_columns": snake_case_columns,
        "save_table_roundtrip": save_table_roundtrip,
        "normalized_csv_export": normalized_csv_export,
        "typed_csv_load": typed_csv_load,
        "quarantined_rows": quarantined_rows,
        "quarantine_passed": quarantine_passed,
        "contract_violations": contract_violations,
        "table_history": table_history,
        "read_version": read_version,
        "drop_columns": drop_columns,
        "cast_columns": cast_columns,
        "try_cast_columns": try_cast_columns,
        "parse_timestamps": parse_timestamps,
        "fill_nulls": fill_nulls,
        "drop_exact_duplicates": drop_exact_duplicates,
        "dedupe_counts": dedupe_counts,
        "delay_days": delay_days,
        "silver_flat": silver_flat,
        "dedupe_by_key": dedupe_by_key,
        "dim_categories": _dim("categories"),
        "dim_products": _dim("products"),
        "dim_customers": _dim("customers"),
        "fact_orders": _dim("orders"),
        "fact_order_items": _dim("order_items"),
        "fact_shipments": _dim("shipments"),
        "profile_columns": profile_columns,
        "null_counts": null_counts,
        "null_total": null_total,
        "duplicate_row_count": duplicate_row_count,
        "table_row_counts": table_row_counts,
        "pk_violations": pk_violations,
        "raw_key_repeats": raw_key_repeats,
        "fk_orphans": fk_orphans,
        "reconcile_flat_vs_relational": reconcile_flat_vs_relational,
        "key_conflicts": key_conflicts,
    }
    out.update({name: _join(name) for name in JOIN_COLUMNS})
    return out




def incremental_gold_shipping_risk(s: SparkSession, d: str) -> DataFrame:
    """Raw files streamed in a few at a time; the last gold version must
    equal the batch gold table."""
    from shiprisk.streaming import incremental

    raw = _raw(s, d)
    root = work_dir(s, "stream")
    csv_io.write_raw_csv(raw, f"{root}/incoming", compression="gzip")
    types = {f.name: f.dataType for f in raw.schema.fields
             if not isinstance(f.dataType, (T.StringType, T.TimestampNTZType))}
    incremental.run_gold_refresh(s, f"{root}/incoming", f"{root}/tables", f"{root}/checkpoint", types, BRONZE_TS,
                                 files_per_trigger=4)
    return tables.read_run(s, f"{root}/tables/gold_shipping_risk")


def streaming_queries() -> dict:
    return {"incremental_gold_shipping_risk": incremental_gold_shipping_risk,
            "medallion_refresh": medallion_refresh}


def medallion_refresh(s: SparkSession, d: str) -> DataFrame:
    """Raw CSV of the test bed through every layer; row count per table."""
    from shiprisk.plans.medallion import run_medallion

    raw = _raw(s, d)
    root = work_dir(s, "medallion")
    csv_io.write_raw_csv(raw, f"{root}/raw", compression="gzip")
    types = {f.name: f.dataType for f in raw.schema.fields
             if not isinstance(f.dataType, (T.StringType, T.TimestampNTZType))}
    return run_medallion(s, f"{root}/raw", f"{root}/tables", CUTOFF, types, BRONZE_TS)


def _dedupe_dims() -> dict:
    out = {}
    for t in DEDUPED_TABLES:
        pairs = TABLE_COLUMNS[t]
        key = dict(pairs)[PRIMARY_KEYS[t]]
        out[t] = (key, [src for out_, src in pairs if src != key])
    return out


def key_conflicts(s: SparkSession, d: str) -> DataFrame:
    """Dimension keys of the cleaned rows whose payload is not unique."""
    cleaned = clean.clean_typed(_raw(s, d), digests_first=False)
    return audit.key_conflicts(cleaned, _dedupe_dims())
