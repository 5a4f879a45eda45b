"""Calendar expressions shared by the reports and the model features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Month of the order as a number (yyyyMM): the partition column of the written flat table.
MONTH_NO = "order_month_no"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def weekday_name(col: str | Column) -> Column:
    """Full English weekday name (Monday ... Sunday)."""
    return F.date_format(_c(col), "EEEE")


def weekday_index(col: str | Column) -> Column:
    """Weekday number with Monday = 0 and Sunday = 6."""
    return F.weekday(_c(col))


def month_label(col: str | Column) -> Column:
    """Month as text yyyy-MM (sorts in calendar order)."""
    return F.date_format(_c(col), "yyyy-MM")


def before(col: str | Column, cutoff: str) -> Column:
    """Strict ``col < cutoff`` on a TIMESTAMP_NTZ column.

    The bound is a literal so the comparison reaches the Parquet scan as a
    pushed filter and prunes row groups.
    """
    return _c(col) < F.lit(cutoff).cast("timestamp_ntz")


def month_no(col: str | Column) -> Column:
    """yyyyMM as a number."""
    return (F.year(_c(col)) * 100 + F.month(_c(col))).cast("int")


def rows_before(df: DataFrame, cutoff: str, col: str = "order_date") -> DataFrame:
    """Rows with ``col < cutoff``; where the rows are partitioned by month, later months aren't opened."""
    out = df.where(before(col, cutoff))
    return out.where(F.col(MONTH_NO) <= int(cutoff[:4]) * 100 + int(cutoff[5:7])) if MONTH_NO in df.columns else out


def rows_of_year(df: DataFrame, year: int, col: str = "order_date") -> DataFrame:
    """Rows of a year; where the rows are partitioned by month, other years aren't opened."""
    out = df.where(year_range(col, year))
    return out.where(F.col(MONTH_NO).between(year * 100 + 1, year * 100 + 12)) if MONTH_NO in df.columns else out


def year_range(col: str | Column, year: int) -> Column:
    """``year(col) = year`` written as a range, so it pushes down."""
    start = F.lit(f"{year:04d}-01-01").cast("timestamp_ntz")
    end = F.lit(f"{year + 1:04d}-01-01").cast("timestamp_ntz")
    return (_c(col) >= start) & (_c(col) < end)
