import pytest
from pyspark.sql import functions as F

from shiprisk.model import SupplyTables
from shiprisk.operators import audit
from shiprisk.schemas import contract
from shiprisk.sources import tables as stored

from fixtures import tables


def test_fk_report_finds_orphans_and_childless(spark):
    got = {r.relation: (r.orphan_rows, r.childless_parents) for r in audit.fk_report(tables(spark)).collect()}
    assert got["products.category_id -> categories.category_id"] == (1, 0)
    assert got["order_items.order_id -> orders.order_id"] == (0, 1)   # order 3 has no lines
    assert got["shipments.order_item_id -> order_items.order_item_id"] == (0, 1)  # item 99


def test_pk_report(spark):
    t = tables(spark)
    doubled = SupplyTables(t.categories.unionByName(t.categories.limit(1)), t.products, t.customers,
                           t.orders, t.order_items, t.shipments)
    got = {r.table_name: (r.duplicated_keys, r.excess_rows) for r in audit.pk_report(doubled).collect()}
    assert got["categories"] == (1, 1) and got["orders"] == (0, 0)


def test_profile_nulls_duplicates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    prof = {r.column_name: (r.data_type, r.non_null_count, r.row_count) for r in audit.profile_columns(df).collect()}
    assert prof == {"a": ("int", 3, 3), "b": ("string", 1, 3)}
    assert [tuple(r) for r in audit.null_counts(df).collect()] == [("b", 2)]
    assert audit.null_total(df).collect()[0][0] == 2
    d = audit.duplicate_row_count(df).collect()[0]
    assert (d.n_rows, d.n_distinct, d.duplicate_rows) == (3, 2, 1)


def test_conform_counts_violations(spark):
    df = spark.createDataFrame([("1", "Tech", "10", "D"), ("x", "Toys", "20", "K"), (None, "A", "3", "B")],
                               "category_id string, category_name string, department_id string, department_name string")
    good, bad = audit.conform(df, contract("categories"))
    counts = {(r.column_name, r.reason): r.n_rows for r in bad.collect()}
    assert counts[("category_id", "bad_cast")] == 1 and counts[("category_id", "null_in_not_null")] == 1
    assert good.count() == 1 and dict(good.dtypes)["category_id"] == "int"


def test_reconcile(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    b = spark.createDataFrame([("x", 1), ("z", 2)], "k string, v int")
    got = {r.k: r.matches for r in audit.reconcile(a, b, ["k"], ["v"]).collect()}
    assert got == {"x": True, "y": False, "z": False}


def test_save_table_replaces_data_and_schema_and_counts_rows(spark, tmp_root):
    assert stored.save_table(spark.range(5), "saved_t", f"{tmp_root}/a") == 5
    assert stored.save_table(spark.range(7).selectExpr("id", "id * 2 as twice"), "saved_t", f"{tmp_root}/b") == 7
    assert stored.read_table(spark, "saved_t").columns == ["id", "twice"]
    assert stored.read_table(spark, "saved_t").count() == 7
    assert stored.save_table(spark.range(0), "saved_t", f"{tmp_root}/c") == 0
    assert stored.read_table(spark, "saved_t").count() == 0
    joined = spark.range(50).join(spark.range(20).withColumnRenamed("id", "k"), F.expr("id % 20 = k")).groupBy("k").count()
    assert stored.save_table(joined, "saved_t", f"{tmp_root}/d") == 20


def test_runs_are_write_once_partitions(spark, tmp_root):
    assert stored.history(spark, tmp_root).count() == 0 and stored.latest_run(spark, tmp_root) is None
    assert stored.save_run(spark.range(5), tmp_root) == 0
    assert stored.save_run(spark.range(9), tmp_root, operation="MERGE") == 1
    hist = stored.history(spark, tmp_root).orderBy("version").collect()
    assert [(h.version, h.operation, h.n_rows) for h in hist] == [(0, "WRITE", 5), (1, "MERGE", 9)]
    assert hist[0].committed_at < hist[1].committed_at
    assert stored.read_run(spark, tmp_root).count() == 9 and stored.read_run(spark, tmp_root, 0).columns == ["id"]
    plan = stored.read_run(spark, tmp_root, 0)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan and "(run_id" in plan
    for wrong in (lambda: stored.save_run(spark.range(3), tmp_root, 1),
                  lambda: stored.save_run(spark.range(3).selectExpr("id", "1 AS more"), tmp_root),
                  lambda: stored.save_run(spark.range(3).selectExpr("id AS run_id"), tmp_root),
                  lambda: stored.read_run(spark, tmp_root, 9)):
        with pytest.raises(ValueError):
            wrong()
    # a replay replaces its own run only, and a job that dies leaves no half run
    assert stored.save_run(spark.range(3), tmp_root, 1, replace=True) == 1
    broken = spark.range(4).select(F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("died"))).cast("long").alias("id"))
    with pytest.raises(Exception, match="died"):
        stored.save_run(broken, tmp_root, 2)
    assert [(h.version, h.n_rows) for h in stored.history(spark, tmp_root).orderBy("version").collect()] == [(0, 5), (1, 3)]


def test_pk_report_projected_equals_per_table(spark):
    from shiprisk.operators.clean import project_rename
    from shiprisk.schemas import PRIMARY_KEYS, TABLE_COLUMNS

    rows = spark.createDataFrame(
        [(1, 10, "a"), (1, 11, "b"), (2, 12, "c"), (None, 12, "d")],
        "order_id int, order_item_id int, note string")
    layout = {"orders": [("order_id", "order_id")], "order_items": [("order_item_id", "order_item_id")]}
    per_table = SupplyTables(*[project_rename(rows, layout.get(t, [(PRIMARY_KEYS[t], "order_id")]))
                               for t in TABLE_COLUMNS])
    a = {r.table_name: tuple(r) for r in audit.pk_report(per_table).collect()
         if r.table_name in layout}
    b = {r.table_name: tuple(r[c] for c in audit.pk_report(per_table).columns)
         for r in audit.pk_report_projected(rows, {"orders": "order_id", "order_items": "order_item_id"}).collect()}
    assert a == b
    assert a["orders"][2:] == (4, 2, 1, 1, 1)


def test_key_conflicts_finds_non_functional_keys(spark):
    rows = spark.createDataFrame(
        [(1, "Phone", 10), (1, "Phone", 11), (2, "Lamp", 12), (2, "Lamp v2", 13)],
        "product_card_id int, product_name string, order_item_id int")
    got = audit.key_conflicts(rows, {"products": ("product_card_id", ["product_name"])}).collect()
    assert [(r.table_name, r.n_keys, r.conflicting_keys) for r in got] == [("products", 2, 1)]
