"""Gold aggregate tables over the flat silver table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiprisk import config
from shiprisk.functions.calendar import month_label, rows_before
from shiprisk.functions.rounding import cents, money, ratio_round, rate_pct


RISK_KEY = ["shipping_mode", "market", "order_region"]


def risk_partials(rows: DataFrame) -> DataFrame:
    """Shipments, late ones and days of delay per key: these add up over any split of the rows."""
    return rows.groupBy(*RISK_KEY).agg(
        F.count(F.lit(1)).alias("total_shipments"),
        F.sum("late_delivery_risk").cast("bigint").alias("late_shipments"),
        F.sum("delay_days").cast("bigint").alias("delay_sum"))


def risk_rates(partials: DataFrame) -> DataFrame:
    """GT1 from any number of partial rows per key."""
    added = partials.groupBy(*RISK_KEY).agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("total_shipments", "late_shipments", "delay_sum")])
    return added.select(*RISK_KEY, "total_shipments", "late_shipments",
                        rate_pct("late_shipments", "total_shipments").alias("late_rate_pct"),
                        ratio_round("delay_sum", "total_shipments").alias("avg_delay_days"))


def gold_shipping_risk(flat: DataFrame) -> DataFrame:
    """GT1: mode x market x region -> shipments, late, rate, average delay.

    Uses every row: lateness is not affected by the price anomaly.
    """
    return (
        risk_partials(flat)
        .select(*RISK_KEY, "total_shipments", "late_shipments",
                rate_pct("late_shipments", "total_shipments").alias("late_rate_pct"),
                ratio_round("delay_sum", "total_shipments").alias("avg_delay_days"))
    )


def gold_monthly_revenue_by_market(flat: DataFrame, cutoff: str = config.DATA_CUTOFF,
                                   approx_rsd: float | None = None) -> DataFrame:
    """GT2: market x month -> distinct orders, revenue, profit (before cutoff).

    ``countDistinct`` is planned as a two-level aggregate keyed by
    (market, month, order_id): no single hot key even if one market
    dominates.  ``approx_rsd`` switches to a sketch-based estimate.
    """
    from shiprisk.plans.reports import distinct_orders

    return (
        rows_before(flat, cutoff)
        .groupBy("market", month_label("order_date").alias("order_month"))
        .agg(distinct_orders(approx_rsd),
             money(F.sum("sales")).alias("revenue"),
             money(F.sum("order_profit_per_order")).alias("profit"))
    )


def gold_category_profitability(flat: DataFrame, cutoff: str = config.DATA_CUTOFF) -> DataFrame:
    """GT3: category x department -> lines, revenue, profit, margin %."""
    return (
        rows_before(flat, cutoff)
        .groupBy("category_name", "department_name")
        .agg(F.count(F.lit(1)).alias("line_items"),
             F.sum(cents("sales")).alias("_rev_c"),
             F.sum(cents("order_profit_per_order")).alias("_profit_c"))
        .select("category_name", "department_name", "line_items",
                (F.col("_rev_c").cast("double") / 100.0).alias("revenue"),
                (F.col("_profit_c").cast("double") / 100.0).alias("profit"),
                ratio_round("_profit_c", "_rev_c", 2, 100).alias("profit_margin_pct"))
    )


def build_gold(flat: DataFrame, cutoff: str = config.DATA_CUTOFF) -> dict[str, DataFrame]:
    return {
        "gold_shipping_risk": gold_shipping_risk(flat),
        "gold_monthly_revenue_by_market": gold_monthly_revenue_by_market(flat, cutoff),
        "gold_category_profitability": gold_category_profitability(flat, cutoff),
    }
