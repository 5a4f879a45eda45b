"""Business questions over the six tables (Q1-Q10), EDA and KPI views.

Each report takes a :class:`SupplyTables` and returns a lazy DataFrame.
Grouping keys are low-cardinality (modes, markets, regions, months), so every
report is a partial aggregate on the map side followed by a small final
aggregate; no report collects rows to the driver.  Top-k reports break ties
on the group keys so results are deterministic.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiprisk import config
from shiprisk.functions.buckets import discount_bucket
from shiprisk.functions.calendar import month_label, rows_before, rows_of_year, weekday_name
from shiprisk.functions.rounding import cents, money, ratio_round, rate_pct
from shiprisk.model import SupplyTables


def _late_counts(*extra):
    return [
        F.count(F.lit(1)).alias("total_shipments"),
        F.sum("late_delivery_risk").cast("bigint").alias("late_shipments"),
        *extra,
    ]


def distinct_orders(approx_rsd: float | None = None):
    """COUNT(DISTINCT order_id), or its HyperLogLog++ estimate.

    The exact form is planned as a second aggregation level keyed by
    (group, order_id), i.e. one extra shuffle of the distinct pairs.  With
    ``approx_rsd`` (e.g. 0.01) each task keeps a fixed-size sketch per group
    and only sketches are shuffled: the choice for very large inputs when
    an estimate within the stated relative error is acceptable.
    """
    if approx_rsd is None:
        return F.countDistinct("order_id").alias("total_orders")
    return F.approx_count_distinct("order_id", rsd=approx_rsd).alias("total_orders")


def top_k(df: DataFrame, k: int, metric: str, keys: list[str], ascending=False) -> DataFrame:
    """ORDER BY metric, keys LIMIT k (a TakeOrderedAndProject, no full sort)."""
    m = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    return df.orderBy(m, *[F.col(k_).asc() for k_ in keys]).limit(k)


def by_rate(df: DataFrame, metric: str, *keys: str) -> DataFrame:
    """Largest metric first, ties by the keys (a sort of the grouped rows only)."""
    return df.orderBy(F.col(metric).desc_nulls_last(), *keys)


# ----------------------------------------------------------------- Q1 - Q10

def late_rate_by_mode(t: SupplyTables) -> DataFrame:
    """Q1: late rate by shipping mode."""
    rates = (
        t.star("shipments").groupBy("shipping_mode").agg(*_late_counts())
        .select("shipping_mode", "total_shipments", "late_shipments",
                rate_pct("late_shipments", "total_shipments").alias("late_rate_pct"))
    )
    return by_rate(rates, "late_rate_pct", "shipping_mode")


def worst_regions(t: SupplyTables, min_shipments: int = config.MIN_SHIPMENTS,
                  k: int = config.TOP_REGIONS) -> DataFrame:
    """Q2: worst region/country by late rate among groups with enough shipments."""
    agg = (
        t.star("order_items", "orders", "shipments")
        .groupBy("order_region", "order_country").agg(*_late_counts())
        .where(F.col("total_shipments") >= min_shipments)
        .withColumn("late_rate_pct", rate_pct("late_shipments", "total_shipments"))
    )
    return top_k(agg, k, "late_rate_pct", ["order_region", "order_country"])


def late_rate_by_category(t: SupplyTables) -> DataFrame:
    """Q3: late rate by category name (equal names merge across departments)."""
    rates = (
        t.star("order_items", "products", "categories", "shipments")
        .groupBy("category_name").agg(*_late_counts())
        .withColumn("late_rate_pct", rate_pct("late_shipments", "total_shipments"))
    )
    return by_rate(rates, "late_rate_pct", "category_name")


def monthly_trend(t: SupplyTables, cutoff: str | None = None,
                  approx_rsd: float | None = None) -> DataFrame:
    """Distinct orders and revenue per calendar month."""
    df = t.star("orders", "order_items")
    if cutoff is not None:
        df = rows_before(df, cutoff)
    return (
        df.groupBy(F.year("order_date").alias("order_year"),
                   F.month("order_date").alias("order_month"))
        .agg(distinct_orders(approx_rsd),
             money(F.sum("sales")).alias("total_revenue"))
        .orderBy("order_year", "order_month")
    )


def segment_profit_vs_late(t: SupplyTables, cutoff: str | None = None) -> DataFrame:
    """Q5: profit, shipments and late rate per customer segment."""
    df = t.star("order_items", "orders", "customers", "shipments")
    if cutoff is not None:
        df = rows_before(df, cutoff)
    return (
        df.groupBy("segment")
        .agg(money(F.sum("profit_per_order")).alias("total_profit"), *_late_counts())
        .withColumn("late_rate_pct", rate_pct("late_shipments", "total_shipments"))
        .orderBy(F.col("total_profit").desc_nulls_last(), "segment")
    )


def discount_vs_late(t: SupplyTables) -> DataFrame:
    """Q6: discount bucket vs quantity and late rate."""
    return (
        t.star("order_items", "shipments")
        .groupBy(discount_bucket("discount_rate").alias("discount_bucket"))
        .agg(*_late_counts(F.sum("quantity").cast("bigint").alias("sum_quantity")))
        .select("discount_bucket", "total_shipments",
                ratio_round("sum_quantity", "total_shipments").alias("avg_quantity"),
                "late_shipments",
                rate_pct("late_shipments", "total_shipments").alias("late_rate_pct"))
        .orderBy(F.col("late_rate_pct").desc_nulls_last(), "discount_bucket")
    )


def market_profit_vs_late(t: SupplyTables, cutoff: str | None = None) -> DataFrame:
    """Q7: profit and late rate per market."""
    df = t.star("order_items", "orders", "shipments")
    if cutoff is not None:
        df = rows_before(df, cutoff)
    return (
        df.groupBy("market")
        .agg(money(F.sum("profit_per_order")).alias("total_profit"), *_late_counts())
        .select("market", "total_profit", "total_shipments",
                rate_pct("late_shipments", "total_shipments").alias("late_rate_pct"))
        .orderBy(F.col("total_profit").desc_nulls_last(), "market")
    )


def avg_delay_by_mode_region(t: SupplyTables, k: int = config.TOP_MODE_REGIONS) -> DataFrame:
    """Q8: average delay (real - scheduled days) per mode and region, top k."""
    agg = (
        t.star("order_items", "orders", "shipments")
        .groupBy("shipping_mode", "order_region")
        .agg(F.sum(F.col("days_for_shipping_real") - F.col("days_for_shipment_scheduled"))
             .cast("bigint").alias("sum_delay"),
             F.count(F.lit(1)).alias("total_shipments"))
        .select("shipping_mode", "order_region",
                ratio_round("sum_delay", "total_shipments").alias("avg_delay_days"),
                "total_shipments")
    )
    return top_k(agg, k, "avg_delay_days", ["shipping_mode", "order_region"])


def weekday_volume(t: SupplyTables, cutoff: str | None = None,
                   approx_rsd: float | None = None) -> DataFrame:
    """Q9: distinct orders and revenue per weekday name."""
    df = t.star("orders", "order_items")
    if cutoff is not None:
        df = rows_before(df, cutoff)
    return (
        df.groupBy(weekday_name("order_date").alias("order_weekday"))
        .agg(distinct_orders(approx_rsd),
             money(F.sum("sales")).alias("total_revenue"))
        .orderBy(F.col("total_orders").desc(), "order_weekday")
    )


def top_products(t: SupplyTables, k: int = config.TOP_PRODUCTS,
                 cutoff: str | None = None) -> DataFrame:
    """Q10: top products (by name) by sales, with their late rate."""
    parts = ["order_items", "products", "shipments"] + (["orders"] if cutoff else [])
    df = t.star(*parts)
    if cutoff is not None:
        df = rows_before(df, cutoff)
    agg = (
        df.groupBy("product_name")
        .agg(F.sum("sales").alias("_sales"), *_late_counts())
        .select("product_name", money("_sales").alias("total_sales"), "total_shipments",
                rate_pct("late_shipments", "total_shipments").alias("late_rate_pct"))
    )
    return top_k(agg, k, "total_sales", ["product_name"])


# ------------------------------------------------------- windows and checks

def _monthly_cents(t: SupplyTables) -> DataFrame:
    return (
        t.star("orders", "order_items")
        .groupBy(month_label("order_date").alias("order_month"))
        .agg(F.countDistinct("order_id").alias("total_orders"),
             F.count(F.lit(1)).alias("line_items"),
             F.sum(cents("sales")).alias("revenue_cents"))
        .withColumn("avg_cents", ratio_round("revenue_cents", "line_items", 0).cast("bigint"))
    )


def monthly_volume_check(t: SupplyTables) -> DataFrame:
    """Month, distinct orders, average line sales, revenue (all months)."""
    return _monthly_cents(t).select(
        "order_month", "total_orders",
        (F.col("avg_cents").cast("double") / 100.0).alias("avg_line_item_sales"),
        (F.col("revenue_cents").cast("double") / 100.0).alias("total_revenue"),
    ).orderBy("order_month")


def price_anomaly_months(t: SupplyTables, max_order_change_pct: float = 10.0,
                         min_avg_drop_pct: float = 20.0) -> DataFrame:
    """Months whose order count is steady while the average line falls.

    Compares each month with the previous *present* month (lag over the
    aggregated months; the single-partition window sees one row per month).
    Every month is returned with its changes and a flag.
    """
    from pyspark.sql import Window

    w = Window.orderBy("order_month")
    with_prev = (
        _monthly_cents(t)
        .withColumn("prev_orders", F.lag("total_orders").over(w))
        .withColumn("prev_avg_cents", F.lag("avg_cents").over(w))
        .withColumn("_d_orders", F.col("total_orders") - F.col("prev_orders"))
        .withColumn("_d_avg", F.col("avg_cents") - F.col("prev_avg_cents"))
    )
    return (
        with_prev.select(
            "order_month", "total_orders", "prev_orders",
            (F.col("avg_cents").cast("double") / 100.0).alias("avg_line_item_sales"),
            (F.col("prev_avg_cents").cast("double") / 100.0).alias("prev_avg_line_item_sales"),
            ratio_round("_d_orders", "prev_orders", 2, 100).alias("orders_change_pct"),
            ratio_round("_d_avg", "prev_avg_cents", 2, 100).alias("avg_change_pct"),
        )
        .withColumn(
            "flagged",
            F.coalesce(
                (F.abs("orders_change_pct") <= max_order_change_pct)
                & (F.col("avg_change_pct") <= -min_avg_drop_pct),
                F.lit(False),
            ),
        )
    )


def mom_revenue_change(flat: DataFrame, cutoff: str = config.DATA_CUTOFF) -> DataFrame:
    """Month-over-month revenue change before the cutoff (flat silver)."""
    from pyspark.sql import Window

    monthly = (
        rows_before(flat, cutoff)
        .groupBy(month_label("order_date").alias("order_month"))
        .agg(F.sum(cents("sales")).alias("rev_c"))
    )
    w = Window.orderBy("order_month")  # one row per month: a tiny window
    return (
        monthly.withColumn("prev_c", F.lag("rev_c").over(w))
        .withColumn("d_c", F.col("rev_c") - F.col("prev_c"))
        .select(
            "order_month",
            (F.col("rev_c").cast("double") / 100.0).alias("revenue"),
            (F.col("prev_c").cast("double") / 100.0).alias("prev_month_revenue"),
            ratio_round("d_c", "prev_c", 2, 100).alias("mom_change_pct"),
        )
        .orderBy("order_month")
    )


# ------------------------------------------------------------ EDA and KPIs

def monthly_revenue_before_cutoff(flat: DataFrame, cutoff: str = config.DATA_CUTOFF) -> DataFrame:
    """Revenue per month before the cutoff."""
    return (
        rows_before(flat, cutoff)
        .groupBy(month_label("order_date").alias("order_month"))
        .agg(money(F.sum("sales")).alias("revenue"))
    )


def category_rate_top15(flat: DataFrame, k: int = config.TOP_CATEGORIES) -> DataFrame:
    """Top categories by volume with late rate and the overall rate.

    The overall rate is a grand total over the same grouped rows (a global
    window over at most ``#categories`` rows), so the data is read once.
    """
    from pyspark.sql import Window

    grouped = flat.groupBy("category_name").agg(*_late_counts())
    everything = Window.partitionBy()
    with_overall = (
        grouped
        .withColumn("_all_n", F.sum("total_shipments").over(everything))
        .withColumn("_all_late", F.sum("late_shipments").over(everything))
        .select("category_name", "total_shipments",
                rate_pct("late_shipments", "total_shipments").alias("late_rate_pct"),
                rate_pct("_all_late", "_all_n").alias("overall_late_rate_pct"))
    )
    return top_k(with_overall, k, "total_shipments", ["category_name"])


def co_moments(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, n, mx, my, qx, qy, c) of every pair of columns i <= j, over the rows where both are known.

    n rows, means, sums of squared deviations, sum of their products.  A task
    keeps one such state for all pairs, centred on its own first values, and the
    states (a row a task and pair) are merged by their means, so large means
    don't cancel.  NaN counts as unknown.
    """
    k = len(columns)

    def merged(n, m, q, c):
        """States stacked along the first axis -> one state; m[i, j] is the mean of i where j is known."""
        total = n.sum(axis=0)
        some = np.maximum(total, 1)
        mean = (n * m).sum(axis=0) / some
        off = m - mean
        other = off.swapaxes(-1, -2)
        return total, mean, (q + n * off * off).sum(axis=0), (c + n * off * other).sum(axis=0)

    def states(batches):
        held = None
        for batch in batches:
            x = batch.to_numpy(dtype=float, na_value=np.nan)
            known = ~np.isnan(x)
            if not len(x):
                continue
            first = x[known.argmax(axis=0), np.arange(k)]
            first = np.where(np.isnan(first), 0.0, first)
            z, seen = np.where(known, x - first, 0.0), known.astype(float)
            n, s = seen.T @ seen, z.T @ seen
            some = np.maximum(n, 1)
            state = (n, first[:, None] + s / some, np.maximum((z * z).T @ seen - s * s / some, 0.0), z.T @ z - s * s.T / some)
            held = state if held is None else merged(*(np.stack(p) for p in zip(held, state)))
        if held is not None:
            n, m, q, c = held
            i, j = np.triu_indices(k)
            yield pd.DataFrame({"i": i, "j": j, "n": n[i, j], "mx": m[i, j], "my": m[j, i], "qx": q[i, j],
                                "qy": q[j, i], "c": c[i, j]})

    fields = "n double, mx double, my double, qx double, qy double, c double"

    def together(group: pd.DataFrame) -> pd.DataFrame:
        n, total = group["n"], max(group["n"].sum(), 1.0)
        dx, dy = (group[c] - (n * group[c]).sum() / total for c in ("mx", "my"))
        return pd.DataFrame({"i": [group["i"].iat[0]], "j": [group["j"].iat[0]], "n": [n.sum()],
                             "mx": [(n * group["mx"]).sum() / total], "my": [(n * group["my"]).sum() / total],
                             "qx": [(group["qx"] + n * dx * dx).sum()], "qy": [(group["qy"] + n * dy * dy).sum()],
                             "c": [(group["c"] + n * dx * dy).sum()]})

    doubles = rows.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    parts = doubles.mapInPandas(states, f"i int, j int, {fields}")
    return parts.groupBy("i", "j").applyInPandas(together, f"i int, j int, {fields}")


def corr_matrix(flat: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of numeric columns, long form, 2 decimals.

    Over the rows where neither column is NULL.  The diagonal is 1; a constant
    column gives NULL.
    """
    from shiprisk.schemas import CORRELATION_COLUMNS

    cols = columns or CORRELATION_COLUMNS
    spread = F.col("qx") * F.col("qy")
    value = F.when(spread > 0, F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.col("c") / F.sqrt(spread)))
    found = co_moments(flat, cols).select("i", "j", value.alias("value"))
    cells = [(a, b, min(i, j), max(i, j)) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    every = flat.sparkSession.createDataFrame(cells, "column_x string, column_y string, i int, j int")
    return every.join(found, ["i", "j"], "left").select(
        "column_x", "column_y", F.round("value", 2).alias("correlation"))


def kpi_summary(flat: DataFrame) -> DataFrame:
    """K1: total orders, revenue, overall late rate, busiest shipping mode.

    Rows are first reduced to one per mode (sums and counts; the busiest mode
    has the most shipments, ties to the smallest name); distinct orders are
    counted separately, so only order ids are shuffled for them.
    """
    modes = flat.groupBy("shipping_mode").agg(
        F.sum("sales").alias("sales"), F.count(F.lit(1)).alias("n"),
        F.sum("late_delivery_risk").cast("bigint").alias("late"))
    totals = modes.agg(
        money(F.sum("sales")).alias("total_revenue"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_shipments"),
        F.sum("late").alias("late_shipments"),
        F.min(F.when(F.col("shipping_mode").isNotNull(), F.struct(
            (-F.col("n")).alias("n"), F.col("shipping_mode").alias("mode")))).alias("busiest"))
    orders = flat.agg(F.countDistinct("order_id").alias("total_orders"))
    # One row on either side.
    both = totals.withColumn("one", F.lit(1)).join(orders.withColumn("one", F.lit(1)), "one")
    return both.select("total_orders", "total_revenue", "total_shipments",
                       rate_pct("late_shipments", "total_shipments").alias("late_rate_pct"),
                       F.col("busiest.mode").alias("top_shipping_mode"))


def late_rate_by_country(flat: DataFrame) -> DataFrame:
    """K2: late rate per order country (no minimum)."""
    return (
        flat.groupBy("order_country").agg(*_late_counts())
        .withColumn("late_rate_pct", rate_pct("late_shipments", "total_shipments"))
    )


def spread_dimensions() -> dict:
    """Dimension name -> grouping expression over the flat table."""
    return {
        "shipping_mode": F.col("shipping_mode"),
        "order_region": F.col("order_region"),
        "category_name": F.col("category_name"),
        "customer_segment": F.col("customer_segment"),
        "discount_bucket": discount_bucket("order_item_discount_rate"),
        "market": F.col("market"),
    }


def driver_spread(flat: DataFrame) -> DataFrame:
    """K3: max - min late rate across the groups of each dimension.

    One pass: the rows are expanded once per dimension (grouping sets) and
    aggregated partially before any shuffle.
    """
    dims = spread_dimensions()
    keyed = flat.select(
        *[expr.cast("string").alias(name) for name, expr in dims.items()],
        "late_delivery_risk",
    )
    names = list(dims)
    grouped = keyed.groupingSets([[n] for n in names], *names).agg(
        F.count(F.lit(1)).alias("total_shipments"),
        F.sum("late_delivery_risk").cast("bigint").alias("late_shipments"),
        F.grouping_id().alias("_gid"),
    )
    dim = F.coalesce(*[F.when(F.col("_gid") == (2 ** len(names) - 1) - 2 ** (len(names) - 1 - i),
                              F.lit(n)) for i, n in enumerate(names)])
    rates = grouped.select(
        dim.alias("dimension"),
        (rate_pct("late_shipments", "total_shipments") * 100).cast("bigint").alias("_rate_c"),
    )
    return (
        rates.groupBy("dimension").agg(
            F.count(F.lit(1)).alias("n_groups"),
            F.min("_rate_c").alias("_min"), F.max("_rate_c").alias("_max"))
        .select("dimension", "n_groups",
                (F.col("_min") / 100.0).alias("min_late_rate_pct"),
                (F.col("_max") / 100.0).alias("max_late_rate_pct"),
                ((F.col("_max") - F.col("_min")) / 100.0).alias("spread_pct"))
    )


def monthly_sales_for_year(t: SupplyTables, year: int) -> DataFrame:
    """Sales by month in one year (range filter, pushed down)."""
    return (
        rows_of_year(t.star("orders", "order_items"), year)
        .groupBy(F.month("order_date").alias("order_month"))
        .agg(F.countDistinct("order_id").alias("total_orders"),
             money(F.sum("sales")).alias("total_sales"))
    )


def calendar_features(orders: DataFrame) -> DataFrame:
    """Scalar calendar functions per order: year, month, label, weekday."""
    from shiprisk.functions.calendar import weekday_index

    return orders.select(
        "order_id",
        F.year("order_date").alias("order_year"),
        F.month("order_date").alias("order_month"),
        month_label("order_date").alias("order_month_label"),
        weekday_index("order_date").alias("order_weekday"),
        weekday_name("order_date").alias("order_weekday_name"),
    )
