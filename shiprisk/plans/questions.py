"""The saved question that is no report of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shiprisk.model import SupplyTables
from shiprisk.plans import reports


def worst_on_time_category(t: SupplyTables) -> DataFrame:
    """The category (by name) with the highest late rate; ties by name."""
    return reports.top_k(reports.late_rate_by_category(t), 1, "late_rate_pct", ["category_name"])
