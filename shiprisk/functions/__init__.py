"""Column-expression helpers (all JVM-side, no UDFs)."""

from shiprisk.functions.buckets import discount_bucket
from shiprisk.functions.calendar import month_label, weekday_index, weekday_name
from shiprisk.functions.rounding import cents, money, ratio_round, rate_pct

__all__ = [
    "cents", "discount_bucket", "money", "month_label", "ratio_round", "rate_pct",
    "weekday_index", "weekday_name",
]
