"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver's tables (through the test-bed mapping) in
full; none runs on fixed input alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shiprisk import config
from shiprisk.checks import oracle as O
from shiprisk.plans import gold, questions, reports
from shiprisk.session import apply_defaults
from shiprisk.sources import silver, testbed

CUTOFF = config.TESTBED_CUTOFF

Query = Callable[[SparkSession, str], DataFrame]


def _tables(spark: SparkSession, sf_dir: str):
    """The persisted silver tables (written once per application)."""
    apply_defaults(spark)
    return silver.testbed_silver(spark, sf_dir)


def _flat(spark: SparkSession, sf_dir: str):
    return _tables(spark, sf_dir).flat


def _report_queries() -> dict[str, Query]:
    T, Fl = _tables, _flat
    return {
        "late_rate_by_mode": lambda s, d: reports.late_rate_by_mode(T(s, d)),
        "worst_regions": lambda s, d: reports.worst_regions(T(s, d)),
        "worst_regions_min2400": lambda s, d: reports.worst_regions(T(s, d), min_shipments=2400),
        "late_rate_by_category": lambda s, d: reports.late_rate_by_category(T(s, d)),
        "monthly_trend": lambda s, d: reports.monthly_trend(T(s, d)),
        "monthly_trend_before_cutoff": lambda s, d: reports.monthly_trend(T(s, d), cutoff=CUTOFF),
        "segment_profit_vs_late": lambda s, d: reports.segment_profit_vs_late(T(s, d)),
        "discount_vs_late": lambda s, d: reports.discount_vs_late(T(s, d)),
        "market_profit_vs_late": lambda s, d: reports.market_profit_vs_late(T(s, d)),
        "avg_delay_by_mode_region": lambda s, d: reports.avg_delay_by_mode_region(T(s, d)),
        "weekday_volume": lambda s, d: reports.weekday_volume(T(s, d)),
        "top_products": lambda s, d: reports.top_products(T(s, d)),
        "gold_shipping_risk": lambda s, d: gold.gold_shipping_risk(Fl(s, d)),
        "gold_monthly_revenue_by_market":
            lambda s, d: gold.gold_monthly_revenue_by_market(Fl(s, d), CUTOFF),
        "gold_category_profitability":
            lambda s, d: gold.gold_category_profitability(Fl(s, d), CUTOFF),
        "mom_revenue_change": lambda s, d: reports.mom_revenue_change(Fl(s, d), CUTOFF),
        "monthly_revenue_before_cutoff":
            lambda s, d: reports.monthly_revenue_before_cutoff(Fl(s, d), CUTOFF),
        "category_rate_top15": lambda s, d: reports.category_rate_top15(Fl(s, d)),
        "corr_matrix": lambda s, d: reports.corr_matrix(Fl(s, d)),
        "kpi_summary": lambda s, d: reports.kpi_summary(Fl(s, d)),
        "late_rate_by_country": lambda s, d: reports.late_rate_by_country(Fl(s, d)),
        "driver_spread": lambda s, d: reports.driver_spread(Fl(s, d)),
        "monthly_sales_for_year":
            lambda s, d: reports.monthly_sales_for_year(T(s, d), config.TESTBED_SALES_YEAR),
        "monthly_volume_check": lambda s, d: reports.monthly_volume_check(T(s, d)),
        "price_anomaly_months": lambda s, d: reports.price_anomaly_months(T(s, d)),
        "calendar_features": lambda s, d: reports.calendar_features(T(s, d).orders),
        "worst_on_time_category": lambda s, d: questions.worst_on_time_category(T(s, d)),
    }


def queries() -> dict[str, Query]:
    from shiprisk import registry_jobs

    out: dict[str, Query] = {}
    out.update(_report_queries())
    out.update(registry_jobs.queries())
    out.update(registry_jobs.streaming_queries())
    from shiprisk import registry_ml

    out.update(registry_ml.queries())
    from shiprisk import registry_guard

    out.update(registry_guard.guard_queries())
    return out


def oracle_sql() -> dict[str, str]:
    from shiprisk.checks import oracle_jobs

    out: dict[str, str] = {}
    out.update(O.reports())
    out.update(oracle_jobs.jobs(testbed.FLAT_TYPES))
    from shiprisk.checks import oracle_ml

    out.update(oracle_ml.ml())
    out.update(oracle_ml.guard())
    out["incremental_gold_shipping_risk"] = out["gold_shipping_risk"]
    return {k: v for k, v in out.items() if k in queries()}
