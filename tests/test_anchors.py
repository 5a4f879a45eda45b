
import pytest

import __spark_entry__ as E

from conftest import SF_SMALL

SF_CHECK = "/root/testdata/sf0.01"
Q = E.queries()


def rates(spark, sf):
    return {r.shipping_mode: r.late_rate_pct for r in Q["late_rate_by_mode"](spark, sf).collect()}


def test_q1_anchor_sf0001(spark):
    assert rates(spark, SF_SMALL) == {"Same Day": 85.09, "First Class": 72.62,
                                      "Second Class": 59.24, "Standard Class": 28.86}


def test_q1_anchor_sf001(spark):
    assert rates(spark, SF_CHECK) == {"Same Day": 85.86, "First Class": 71.22,
                                      "Second Class": 57.06, "Standard Class": 28.58}


def test_kpi_anchor_sf001(spark):
    row = Q["kpi_summary"](spark, SF_CHECK).collect()[0]
    assert (row.total_orders, row.total_revenue, row.late_rate_pct, row.top_shipping_mode) == \
        (14743, 3183256271.63, 54.12, "Standard Class")


@pytest.mark.parametrize("name,rows", [
    ("worst_regions", 15), ("worst_regions_min2400", 14), ("late_rate_by_category", 6),
    ("monthly_trend", 80), ("segment_profit_vs_late", 5), ("discount_vs_late", 4),
    ("market_profit_vs_late", 5), ("avg_delay_by_mode_region", 20), ("weekday_volume", 7),
    ("top_products", 10), ("gold_shipping_risk", 60), ("gold_monthly_revenue_by_market", 385),
    ("gold_category_profitability", 150), ("mom_revenue_change", 77), ("monthly_volume_check", 80),
])
def test_row_count_anchors_sf001(spark, name, rows):
    assert Q[name](spark, SF_CHECK).count() == rows


def test_discount_buckets_anchor_sf001(spark):
    got = {r.discount_bucket: r.total_shipments for r in Q["discount_vs_late"](spark, SF_CHECK).collect()}
    assert got == {"No Discount": 2941, "Low (0-10%)": 24154, "Medium (10-20%)": 24066,
                   "High (20%+)": 8839}
