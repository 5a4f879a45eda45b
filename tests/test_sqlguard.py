import pytest

from shiprisk.operators import sqlguard as G

from fixtures import tables

CASES = [
    ("SELECT * FROM shipments", "ok"),
    ("```sql\nselect 1\n```", "ok"),
    ("select count(*) from shipments;", "ok"),
    ("select 1; select 2", "multiple_statements"),
    ("WITH x AS (select 1) select * from x", "not_select"),
    ("select replace(shipping_mode, 'a', 'b') from shipments", "forbidden_keyword"),
    ("select created from t", "ok"),
    ("select 'drop' as word", "forbidden_keyword"),
    ("-- hi\nselect 1", "not_select"),
    ("select * from x; DROP TABLE y", "multiple_statements"),
    ("Select * from t where note = 'a;b'", "multiple_statements"),
]


def test_column_verdict(spark):
    df = spark.createDataFrame([(t,) for t, _ in CASES], "raw string")
    got = [r[0] for r in df.select(G.guard_verdict(G.extract_sql("raw"))).collect()]
    assert got == [e for _, e in CASES]


def test_extract_drops_fences(spark):
    texts = ["  ```SQL\n select 1 \n```  ", "```select 2```", "select 3", "``` select 4"]
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    assert [r[0] for r in df.select(G.extract_sql("raw")).collect()] == [f"select {i}" for i in (1, 2, 3, 4)]


def test_run_guarded_returns_all_rows_unless_capped(spark):
    t = tables(spark).as_dict()
    n = t["order_items"].count()
    assert G.run_guarded(spark, "select * from order_items", t).count() == n
    assert G.run_guarded(spark, "select * from order_items", t, row_cap=3).count() == 3
    agg = G.run_guarded(spark, "select shipping_mode, count(*) from shipments group by 1", t)
    assert agg.count() == 4


def test_run_guarded_keeps_the_callers_views(spark):
    spark.range(5).createOrReplaceTempView("shipments")
    t = tables(spark).as_dict()
    assert G.run_guarded(spark, "select count(*) as n from shipments", t).first()["n"] == t["shipments"].count()
    assert spark.table("shipments").count() == 5
    spark.catalog.dropTempView("shipments")


REFUSED = [
    "select * from parquet.`{path}`",
    "select (select max(id) from parquet.`{path}`) as x from shipments",
    "select * from shipments where exists (select 1 from parquet.`{path}`)",
    "select * from (with x as (select * from parquet.`{path}`) select * from x)",
    "select java_method('java.lang.System', 'getenv', 'HOME')",
    "select `reflect`('java.lang.System', 'getenv', 'HOME') from shipments",
    "select 'a' as `reflect` , `java_method` ('java.lang.System', 'getenv', 'HOME')",
    "select r'\\', reflect('java.lang.System', 'getenv', 'HOME') --'",
    "select * from range(10)",
    "select * from other_view",
    "select (select max(id) from other_view) from shipments",
    "select * from global_temp.shared_view",
    "select * from default.kept_table",
    "delete from shipments",
    "select * from no_such_table",
    "select * from read_files('{path}')",
]


@pytest.mark.parametrize("text", REFUSED)
def test_run_guarded_refuses(spark, tmp_root, text):
    t = tables(spark).as_dict()
    spark.range(3).write.parquet(f"{tmp_root}/secret")
    spark.range(3).createOrReplaceTempView("other_view")
    spark.range(3).createOrReplaceGlobalTempView("shared_view")
    with pytest.raises(G.UnsafeQueryError):
        G.run_guarded(spark, text.replace("{path}", f"{tmp_root}/secret"), t)


@pytest.mark.parametrize("text", [
    "select * from (with x as (select * from shipments) select * from x) limit 2",
    "select order_id from orders where customer_id in (select customer_id from customers)",
    "select 1 as one", "select count(distinct order_id) from order_items;",
    "select s.shipping_mode, round(avg(oi.sales), 2) from order_items oi join shipments s "
    "on oi.order_item_id = s.order_item_id group by s.shipping_mode",
])
def test_run_guarded_accepts(spark, text):
    assert G.run_guarded(spark, text, tables(spark).as_dict()).count() >= 1


def test_preview_is_ordered_and_bounded(spark):
    df = tables(spark).order_items
    out = G.preview(df, 2).collect()
    assert [r.order_item_id for r in out] == [11, 12]
