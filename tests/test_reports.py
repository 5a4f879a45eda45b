from shiprisk.model import SupplyTables
from shiprisk.plans import gold, reports

from fixtures import tables


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_q1_late_rate_by_mode(spark):
    out = reports.late_rate_by_mode(tables(spark))
    assert rows(out, "shipping_mode", "total_shipments", "late_shipments", "late_rate_pct") == [
        ("First Class", 2, 2, 100.0), ("Same Day", 1, 0, 0.0), ("Second Class", 1, 1, 100.0),
        ("Standard Class", 2, 1, 50.0)]


def test_inner_joins_drop_items_without_shipment_or_category(spark):
    t = tables(spark)
    cat = reports.late_rate_by_category(t)
    # item 99 (no shipment) and item 51 (unknown category) disappear;
    # 'Electronics' merges across two departments.
    assert rows(cat, "category_name", "total_shipments") == [("Electronics", 4), ("Toys ", 1)]


def test_q2_having_edge_and_tie_break(spark):
    t = tables(spark)
    assert reports.worst_regions(t, min_shipments=5).count() == 0
    assert reports.worst_regions(t, min_shipments=4).count() == 1  # 4 shipments: kept at >= 4
    out = reports.worst_regions(t, min_shipments=3, k=1)
    assert rows(out, "order_region", "total_shipments") == [("Northern Europe", 4)]
    two = reports.worst_regions(t, min_shipments=1, k=2).collect()
    assert [r.order_region for r in two] == ["Northern Europe", "South America"]


def test_q4_cutoff_is_strict(spark):
    t = tables(spark)
    all_months = rows(reports.monthly_trend(t), "order_year", "order_month", "total_orders")
    assert all_months == [(2017, 9, 2), (2017, 10, 1), (2017, 11, 1)]
    before = rows(reports.monthly_trend(t, cutoff="2017-11-01"), "order_month")
    assert before == [(9,), (10,)]


def test_q6_buckets_and_avg_quantity(spark):
    out = reports.discount_vs_late(tables(spark))
    assert rows(out, "discount_bucket", "total_shipments", "avg_quantity") == [
        ("High (20%+)", 1, 1.0), ("Low (0-10%)", 1, 2.0), ("Medium (10-20%)", 2, 3.5),
        ("No Discount", 2, 1.0)]


def test_q8_negative_delay(spark):
    out = reports.avg_delay_by_mode_region(tables(spark))
    got = dict(((r.shipping_mode, r.order_region), r.avg_delay_days) for r in out.collect())
    assert got[("Standard Class", "South America")] == -0.5


def test_q9_weekday_names(spark):
    out = rows(reports.weekday_volume(tables(spark)), "order_weekday", "total_orders")
    assert ("Sunday", 1) in out and ("Monday", 1) in out


def test_flat_shortcut_equals_relational(spark):
    # The shortcut holds under the key contract (no orphans, every item
    # shipped), which the fk_orphans audit checks: drop the two broken items.
    raw = tables(spark)
    t = SupplyTables(raw.categories, raw.products, raw.customers, raw.orders,
                     raw.order_items.where("order_item_id not in (51, 99)"),
                     raw.shipments.where("order_item_id <> 51"))
    flat_like = t.star(*t.as_dict().keys())
    # flat built from the relational star (same rows as a silver flat table)
    from shiprisk.schemas import TABLE_COLUMNS
    cols = {}
    for table, pairs in TABLE_COLUMNS.items():
        for out, src in pairs:
            name = "catalog_price" if (table, out) == ("products", "product_price") else out
            cols.setdefault(src, name)
    flat = flat_like.selectExpr(*[f"{star} as {src}" for src, star in cols.items() if star in flat_like.columns])
    with_flat = SupplyTables(*(t.table(n) for n in TABLE_COLUMNS), flat=flat)
    for fn in [reports.worst_regions, reports.late_rate_by_category, reports.segment_profit_vs_late,
               reports.market_profit_vs_late, reports.top_products, reports.avg_delay_by_mode_region]:
        a, b = fn(t), fn(with_flat)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())), fn.__name__


def test_window_uses_previous_present_month(spark):
    t = tables(spark)
    # October has no order here: November is compared with September.
    flat = t.star("order_items", "orders").where("order_id <> 1")
    out = reports.mom_revenue_change(flat, cutoff="2018-01-01").orderBy("order_month").collect()
    assert [r.order_month for r in out] == ["2017-09", "2017-11"]
    assert out[0].prev_month_revenue is None and out[1].prev_month_revenue == 60.99
    assert out[1].mom_change_pct == round((79.99 - 60.99) / 60.99 * 100, 2)


def test_gold_margin_zero_revenue_is_null(spark):
    import datetime as dt
    from decimal import Decimal as D
    flat = spark.createDataFrame(
        [("A", "D1", D("0.00"), D("1.00"), dt.datetime(2017, 1, 1)),
         ("B", "D1", D("10.00"), D("-2.50"), dt.datetime(2017, 1, 1))],
        "category_name string, department_name string, sales decimal(10,2), "
        "order_profit_per_order decimal(10,2), order_date timestamp_ntz")
    got = {r.category_name: r.profit_margin_pct for r in gold.gold_category_profitability(flat).collect()}
    assert got == {"A": None, "B": -25.0}


def test_group_sums_add_up(spark):
    t = tables(spark)
    total = sum(r.late_shipments for r in reports.late_rate_by_mode(t).collect())
    by_bucket = sum(r.late_shipments for r in reports.discount_vs_late(t).collect())
    assert total == 4 and by_bucket == 4


def test_repartitioning_does_not_change_results(spark):
    t = tables(spark)
    moved = SupplyTables(*(t.table(n).repartition(3) for n in t.as_dict()))
    a = reports.late_rate_by_category(t).collect()
    b = reports.late_rate_by_category(moved).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_approx_distinct_close_to_exact(spark):
    t = tables(spark)
    exact = {(r.order_year, r.order_month): r.total_orders for r in reports.monthly_trend(t).collect()}
    approx = {(r.order_year, r.order_month): r.total_orders
              for r in reports.monthly_trend(t, approx_rsd=0.01).collect()}
    assert exact == approx  # tiny groups are counted exactly by the sketch
