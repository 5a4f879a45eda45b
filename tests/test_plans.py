"""Plan properties the design relies on (checked with explain)."""

import io
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
Q = E.queries()


def plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_q1_reads_two_columns_with_partial_aggregate(spark):
    p = plan(Q["late_rate_by_mode"](spark, SF))
    assert "ReadSchema: struct<late_delivery_risk:int,shipping_mode:string>" in p
    assert p.count("HashAggregate") >= 2  # partial + final around one Exchange


def test_cutoff_reaches_the_scan(spark):
    p = plan(Q["gold_monthly_revenue_by_market"](spark, SF))
    assert "PushedFilters: [IsNotNull(order_date), LessThan(order_date,2001-06-01T00:00)]" in p


@pytest.mark.parametrize("name", ["monthly_trend_before_cutoff", "gold_monthly_revenue_by_market",
                                  "gold_category_profitability", "mom_revenue_change", "monthly_sales_for_year"])
def test_months_are_pruned(spark, name):
    p = plan(Q[name](spark, SF))
    assert "PartitionFilters: [isnotnull(order_month_no" in p


def test_large_months_are_several_files(spark, tmp_root):
    from pyspark.sql import functions as F

    from shiprisk.functions.calendar import MONTH_NO
    from shiprisk.sources import silver, testbed

    flat = testbed.flat(spark, SF).withColumn("order_date", F.lit("1995-03-05").cast("timestamp_ntz"))
    flat = flat.unionByName(testbed.flat(spark, SF).where("order_id % 50 = 0"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one partition
    try:
        silver.write_silver(flat, testbed.tables(spark, SF, with_flat=False), f"{tmp_root}/skewed", buckets=0)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    written = spark.read.parquet(f"{tmp_root}/skewed/flat")
    files = written.select(MONTH_NO, F.input_file_name().alias("f")).groupBy(MONTH_NO).agg(
        F.countDistinct("f").alias("files"), F.count("*").alias("n"))
    hot = files.orderBy(F.desc("n")).first()
    assert hot[MONTH_NO] == 199503 and hot["files"] >= 4


def test_top_k_is_take_ordered(spark):
    assert "TakeOrderedAndProject" in plan(Q["top_products"](spark, SF))


def test_grouping_sets_single_pass(spark):
    tree = plan(Q["driver_spread"](spark, SF)).split("\n\n")[0]
    assert tree.count("Expand") == 1 and tree.count("Scan parquet") == 1


@pytest.fixture()
def no_broadcast(spark):
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_bucketed_one_to_one_join_has_no_exchange(spark, no_broadcast):
    p = plan(Q["join_items_shipments"](spark, SF))
    tree = p.split("\n\n")[0]
    assert "SortMergeJoin" in tree and "Exchange" not in tree
    assert "Bucketed: true" in p


def test_item_order_join_shuffles_one_side(spark, no_broadcast):
    tree = plan(Q["join_items_orders"](spark, SF)).split("\n\n")[0]
    assert "SortMergeJoin" in tree and tree.count("Exchange") == 1
