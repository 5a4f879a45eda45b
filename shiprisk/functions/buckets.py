"""Discount-rate buckets (exact decimal edges)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from shiprisk.schemas import DISCOUNT_BUCKETS

NONE_, LOW, MEDIUM, HIGH = DISCOUNT_BUCKETS


def discount_bucket(rate: str | Column) -> Column:
    """= 0, <= 0.10, <= 0.20, else (NULL falls into the last bucket)."""
    r = F.col(rate) if isinstance(rate, str) else rate
    return (
        F.when(r == F.lit(Decimal("0")), NONE_)
        .when(r <= F.lit(Decimal("0.10")), LOW)
        .when(r <= F.lit(Decimal("0.20")), MEDIUM)
        .otherwise(HIGH)
    )
