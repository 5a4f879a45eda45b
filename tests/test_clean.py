import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import PySparkException
from py4j.protocol import Py4JJavaError

from shiprisk.operators import clean
from shiprisk.sources import csv_io


def test_snake_case_names():
    assert clean.snake_case("Days for shipping (real)") == "days_for_shipping_real"
    assert clean.snake_case("  order date (DateOrders) ") == "order_date_dateorders"
    assert clean.snake_case("Late_delivery_risk") == "late_delivery_risk"
    assert clean.snake_case("Shipping date (DateOrders)") == clean.snake_case("shipping date (DateOrders)")


def test_snake_case_collision_raises(spark):
    df = spark.createDataFrame([(1, 2)], "`Order Id` int, `order-id` int")
    with pytest.raises(clean.ColumnCollisionError):
        clean.snake_case_columns(df)


def test_cast_fail_vs_null(spark):
    df = spark.createDataFrame([("12",), ("",), ("725.0",), ("abc",), (None,)], "z string")
    got = [r[0] for r in clean.cast_columns(df, {"z": T.IntegerType()}, on_error="null").collect()]
    assert got == [12, None, 725, None, None]  # 725.0 is the whole number 725
    with pytest.raises((PySparkException, Py4JJavaError, Exception)):
        clean.cast_columns(df, {"z": T.IntegerType()}, on_error="fail").collect()


def test_parse_timestamps(spark):
    df = spark.createDataFrame([("1/31/2018 22:56",), ("10/2/2017 0:05",)], "order_date_dateorders string")
    out = clean.parse_timestamps(df, {"order_date_dateorders": "order_date"})
    assert out.columns == ["order_date"]
    assert [r[0] for r in out.collect()] == [dt.datetime(2018, 1, 31, 22, 56), dt.datetime(2017, 10, 2, 0, 5)]
    bad = spark.createDataFrame([("2018-01-31",)], "order_date_dateorders string")
    nulls = clean.parse_timestamps(bad, {"order_date_dateorders": "order_date"}, on_error="null")
    assert nulls.collect()[0][0] is None


def test_fill_and_duplicates(spark):
    df = spark.createDataFrame(
        [(1, None, None, None), (1, None, None, None), (2, "A1", "Doe", 725)],
        "order_item_id int, order_zipcode string, customer_lname string, customer_zipcode int")
    filled = clean.fill_nulls(df)
    assert filled.where("order_zipcode = 'UNKNOWN' and customer_lname = 'UNKNOWN' and customer_zipcode = 0").count() == 2
    assert clean.drop_exact_duplicates(filled).count() == 2
    rep = clean.dedupe_report(df).collect()[0]
    assert (rep.rows_before, rep.rows_after, rep.duplicates_removed) == (3, 2, 1)


def test_dedupe_by_key_keeps_first(spark):
    df = spark.createDataFrame([(7, 30, "late"), (7, 10, "first"), (7, 20, "mid"), (8, 5, "only")],
                               "category_id int, order_item_id int, name string")
    got = {r.category_id: r.name for r in clean.dedupe_by_key(df, "category_id", "order_item_id").collect()}
    assert got == {7: "first", 8: "only"}


def test_latin1_csv_roundtrip(spark, tmp_root):
    rows = [("Café \"Noir\", Paris", "1"), ("Señor", "2")]
    df = spark.createDataFrame(rows, "`Customer City` string, `Order Id` string")
    csv_io.write_csv(df, f"{tmp_root}/raw", encoding="ISO-8859-1")
    import glob

    from shiprisk.session import local_path
    raw = b"".join(open(p, "rb").read() for p in glob.glob(f"{local_path(tmp_root)}/raw/part-*"))
    assert b"\xe9" in raw and b'""Noir""' in raw  # latin-1 byte, doubled quotes
    back = clean.snake_case_columns(csv_io.read_raw_csv(spark, f"{tmp_root}/raw"))
    assert back.columns == ["customer_city", "order_id"]
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def test_clean_end_to_end_types(spark):
    df = spark.createDataFrame([("2", "1", "59.99000168", "1/2/2017 3:04", "x", "img", "pw")],
                               "days_for_shipping_real string, days_for_shipment_scheduled string, "
                               "product_price string, order_date_dateorders string, "
                               "product_description string, product_image string, customer_password string")
    types = {"days_for_shipping_real": T.IntegerType(), "days_for_shipment_scheduled": T.IntegerType(),
             "product_price": T.DecimalType(10, 2)}
    out = clean.clean(df, types, {"order_date_dateorders": "order_date"})
    row = out.collect()[0]
    assert row.product_price == Decimal("59.99") and row.delay_days == 1
    assert "product_image" not in out.columns and row.order_date == dt.datetime(2017, 1, 2, 3, 4)


def test_cli_runs_medallion_on_a_raw_file(spark, tmp_root, capsys):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from shiprisk.__main__ import main
    from shiprisk.sources import testbed

    raw = testbed.raw_rows(spark, "/root/testdata/sf0.001")
    # the original file has integer keys: give the test bed's text keys codes
    for c in ["order_item_id", "category_id"]:
        raw = raw.withColumn(c, F.dense_rank().over(Window.orderBy(c)))
    raw = raw.withColumn("product_category_id", F.col("category_id"))
    csv_io.write_raw_csv(raw, f"{tmp_root}/raw")
    code = main(["medallion", "--raw", f"{tmp_root}/raw", "--root", f"{tmp_root}/tables",
                 "--cutoff", "2001-06-01"])
    out = capsys.readouterr().out
    assert code == 0
    for table in ["bronze_supply_chain", "silver_orders", "silver_order_headers",
                  "gold_shipping_risk", "gold_category_profitability"]:
        assert table in out


def test_digest_collisions_are_told_apart(spark, monkeypatch):
    """All rows share one digest: only whole rows decide, for the rows kept and for the counts."""
    rows = [(1, "a", None), (1, "a", None), (1, None, "a"), (2, "b", "c"), (2, "b", "c"), (2, "b", "c"), (3, "", "")]
    df = spark.createDataFrame(rows, "k int, v string, w string").repartition(3)
    monkeypatch.setattr(clean, "row_digests", lambda d: [F.lit(1).cast("long").alias(c) for c in clean.DIGEST])
    assert sorted(map(tuple, clean.drop_exact_duplicates(df).collect()), key=str) == sorted(set(rows), key=str)
    assert tuple(clean.dedupe_report(df).first()) == (7, 4, 3)


def test_duplicates_shuffle_digests_not_rows(spark):
    rows = [(i % 5, "text " * 3, None if i % 2 else i) for i in range(40)] + [(9, "x", 1), (9, "x", 1), (None, None, None)]
    df = spark.createDataFrame(rows, "k int, v string, w int")
    out = clean.drop_exact_duplicates(df)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(set(rows), key=str) and out.columns == df.columns
    assert tuple(clean.dedupe_report(df).first()) == (len(rows), len(set(rows)), len(rows) - len(set(rows)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "LeftAnti, BuildRight" in plan
    empty = df.limit(0)
    assert clean.drop_exact_duplicates(empty).count() == 0 and tuple(clean.dedupe_report(empty).first()) == (0, 0, 0)
