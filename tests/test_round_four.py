"""What the item tables, the checked load, the refresh and the stream no longer write, keep or do twice."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiprisk.operators import clean
from shiprisk.operators.clean import project_rename
from shiprisk.plans.medallion import run_medallion
from shiprisk.registry_jobs import BRONZE_TS
from shiprisk.schemas import TABLE_COLUMNS
from shiprisk.sources import csv_io, silver, testbed
from shiprisk.streaming import incremental

from conftest import SF_SMALL


def types(raw):
    return {f.name: f.dataType for f in raw.schema.fields if not isinstance(f.dataType, (T.StringType, T.TimestampNTZType))}


def same_rows(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("flat_first", [False, True])
def test_items_and_shipments_are_one_table_without_the_flat_one(spark, tmp_root, flat_first):
    t = silver.TestbedSilver(spark, SF_SMALL, f"{tmp_root}/silver_of_{flat_first}", 8)
    if flat_first:
        t.flat.count()
    rel = t.relational()
    flat = testbed.flat(spark, SF_SMALL)
    for name in silver.FLAT_PROJECTIONS:
        assert same_rows(rel.table(name), project_rename(flat, TABLE_COLUMNS[name]))
    assert set(t._held) == {"layout", "lines", "order_items", "shipments"} | ({"flat"} if flat_first else set())


def test_lines_keep_the_rows_of_the_flat_table(spark, tmp_root):
    """Lines without a part, order, customer or nation drop out, repeated parents repeat them, as in the flat table."""
    d = f"{tmp_root}/odd"
    for name in testbed.SOURCE_TABLES:
        df = spark.read.parquet(f"{SF_SMALL}/{name}.parquet")
        key = df.columns[0]
        if name in ("part", "orders", "customer"):
            df = df.where(F.col(key) % 10 != 3)
        if name == "nation":
            df = df.where("n_nationkey <> 4").unionByName(df.where("n_nationkey = 5"))
        if name == "lineitem":
            df = df.withColumn("l_partkey", F.when(F.col("l_partkey") % 7 != 1, F.col("l_partkey")))
        df.write.parquet(f"{d}/{name}.parquet")
    columns = [src for _, src in TABLE_COLUMNS["order_items"]]
    lines, flat = testbed.lines_by_item(spark, d, columns, 3), testbed.flat(spark, d).select(*columns)
    assert 0 < flat.count() and same_rows(lines, flat) and lines.schema == flat.schema


def test_lines_of_good_rows_are_not_kept(spark, tmp_root):
    schema = T.StructType([T.StructField("k", T.LongType(), False), T.StructField("v", T.StringType())])
    spark.createDataFrame([("1,a",), ("x,b",), (",c",), ("2,",)], "value string").write.text(f"{tmp_root}/text", compression="gzip")
    good, bad = csv_io.load_checked(spark, f"{tmp_root}/text", "t", schema, f"{tmp_root}/checked", header=False)
    assert sorted(map(tuple, good.collect())) == [(1, "a"), (2, None)]
    assert sorted((r.line, r.reason) for r in bad.collect()) == [(",c", "null_in_not_null"), ("x,b", "bad_cast")]
    assert spark.read.parquet(f"{tmp_root}/checked").where("not rejected and line is not null").isEmpty()


def test_the_refresh_types_its_rows_once(spark, tmp_root, monkeypatch):
    raw = testbed.raw_rows(spark, SF_SMALL).limit(500)
    csv_io.write_raw_csv(raw, f"{tmp_root}/raw")
    monkeypatch.setattr(clean, "_repeated", lambda df: pytest.fail("the rows are made a second time"))
    counts = {r.table_name: r.n_rows for r in run_medallion(
        spark, f"{tmp_root}/raw", f"{tmp_root}/tables", "2001-06-01", types(raw), BRONZE_TS).collect()}
    assert counts["bronze_supply_chain"] == 500 and counts["silver_cleaned"] <= 500


def test_a_batch_is_dealt_before_it_is_typed(spark, tmp_root, monkeypatch):
    raw = testbed.raw_rows(spark, SF_SMALL).limit(300)
    csv_io.write_raw_csv(raw, f"{tmp_root}/in", compression="gzip")
    seen, typed = [], incremental.typed_rows
    monkeypatch.setattr(incremental, "typed_rows", lambda rows, *a: seen.append(
        rows._jdf.queryExecution().logical().toString()) or typed(rows, *a))
    incremental.run_gold_refresh(spark, f"{tmp_root}/in", f"{tmp_root}/out", f"{tmp_root}/ckpt", types(raw), BRONZE_TS)
    assert len(seen) == 1 and "Repartition" in seen[0]


def test_whole_numbers_are_cast_as_before(spark):
    df = spark.createDataFrame([("725.0",), ("7",), ("7.000 ",), (None,), (" 12",)], "x string")
    out = clean.cast_columns(df, {"x": T.IntegerType()})
    assert [r.x for r in out.collect()] == [725, 7, 7, None, 12]


def test_orders_meet_customers_before_the_lines(spark):
    t = testbed.tables(spark, SF_SMALL, with_flat=False)
    star = t.star("order_items", "orders", "customers")
    old = t.order_items.join(t.orders, "order_id").join(t.customers, "customer_id")
    assert sorted(star.columns) == sorted(old.columns) and same_rows(star.select(*old.columns), old)
    top = star._jdf.queryExecution().analyzed().toString().split("Join Inner")
    assert "(order_id#" in top[1].split("\n")[0]  # the last join is that of the lines
