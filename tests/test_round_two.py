"""Answers in order, exact audits and casts, correlations with nulls and large means."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from shiprisk import session
from shiprisk.operators import audit, clean
from shiprisk.plans import reports
from shiprisk.sources import silver

from conftest import SF_SMALL


def in_order(rows, key):
    values = [key(r) for r in rows]
    return values == sorted(values)


def test_reports_come_in_order(spark):
    t = silver.testbed_silver(spark, SF_SMALL)
    for df, metric in [(reports.late_rate_by_mode(t), "late_rate_pct"),
                       (reports.late_rate_by_category(t), "late_rate_pct"),
                       (reports.discount_vs_late(t), "late_rate_pct"),
                       (reports.segment_profit_vs_late(t), "total_profit"),
                       (reports.market_profit_vs_late(t), "total_profit"),
                       (reports.weekday_volume(t), "total_orders")]:
        assert in_order(df.collect(), lambda r: -r[metric])
    assert in_order(reports.monthly_trend(t).collect(), lambda r: (r.order_year, r.order_month))
    assert in_order(reports.monthly_volume_check(t).collect(), lambda r: r.order_month)
    assert in_order(reports.mom_revenue_change(t.flat, "1998-01-01").collect(), lambda r: r.order_month)


def test_correlations_skip_nulls_pairwise_and_survive_large_means(spark):
    rows = [(1e9 + i * 1e-3, float(i), None if i % 3 else float(2 * i), 5.0) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double").repartition(4)
    got = {(r.column_x, r.column_y): r.correlation for r in reports.corr_matrix(df, ["a", "b", "c", "k"]).collect()}
    assert got["a", "a"] == got["a", "b"] == got["b", "c"] == got["c", "c"] == 1.0
    assert got["k", "k"] is None and got["a", "k"] is None
    assert all(got[x, y] == got[y, x] for x, y in got)


def test_kpi_breaks_ties_by_name_and_ignores_null_modes(spark):
    rows = [(1, "b", 1.0, 1), (2, "a", 2.0, 0), (2, None, 3.0, 1), (3, None, 3.0, 1), (4, None, 1.0, 1)]
    df = spark.createDataFrame(rows, "order_id long, shipping_mode string, sales double, late_delivery_risk int")
    row = reports.kpi_summary(df.withColumn("sales", F.col("sales").cast("decimal(10,2)"))).first()
    assert (row.total_orders, row.total_revenue, row.total_shipments, row.late_rate_pct,
            row.top_shipping_mode) == (4, 10.0, 5, 80.0, "a")


def test_dedupe_by_key_with_null_order_and_ties(spark):
    rows = [(1, None, "x"), (2, None, "y"), (2, 5, "late"), (3, 7, "b"), (3, 7, "a"), (None, 1, "n")]
    df = spark.createDataFrame(rows, "k int, o int, v string")
    for parts in (1, 5):
        got = {tuple(r) for r in clean.dedupe_by_key(df.repartition(parts), "k", "o").collect()}
        assert got == {(1, None, "x"), (2, 5, "late"), (3, 7, "a"), (None, 1, "n")}


def test_key_conflicts_see_where_a_null_is(spark):
    rows = spark.createDataFrame([(1, None, "a"), (1, "a", None), (2, "b", None), (2, "b", None)],
                                 "k int, p string, q string")
    got = audit.key_conflicts(rows, {"t": ("k", ["p", "q"])}).first()
    assert (got.n_keys, got.conflicting_keys) == (2, 1)


def test_whole_numbers_with_a_zero_fraction(spark):
    df = spark.createDataFrame([("725.0", "12"), ("31", None), ("7.00 ", "3000000000")], "z string, key string")
    from pyspark.sql import types as T

    out = clean.cast_columns(df, {"z": T.IntegerType(), "key": T.LongType()})
    assert [tuple(r) for r in out.collect()] == [(725, 12), (31, None), (7, 3_000_000_000)]
    half = clean.cast_columns(spark.createDataFrame([("725.5",)], "z string"), {"z": T.IntegerType()}, "null")
    assert half.first().z in (None, 725)  # try_cast's own rule


def test_pk_report_of_the_six_tables_is_clean(spark):
    rows = audit.pk_report(silver.testbed_silver(spark, SF_SMALL).relational()).collect()
    assert len(rows) == 6
    assert all((r.null_key_rows, r.duplicated_keys, r.excess_rows) == (0, 0, 0) for r in rows)


def test_no_private_folder_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_root(Session())


def test_tables_and_runs_are_written_compactly(spark, tmp_root):
    """Bronze, silver and gold tables of a refresh are kept, so they are compressed well (zstd)."""
    from shiprisk.session import local_path
    from shiprisk.sources import tables

    rows = spark.range(50).withColumnRenamed("id", "n")
    tables.save_table(rows, "compact_table", f"{tmp_root}/table")
    tables.save_run(rows, f"{tmp_root}/runs")
    files = [f for d in ("table", "runs/run_id=0") for f in os.listdir(local_path(f"{tmp_root}/{d}")) if f.endswith(".parquet")]
    assert files and all(".zstd." in f for f in files)
    assert spark.table("compact_table").count() == 50 and tables.read_run(spark, f"{tmp_root}/runs").count() == 50
