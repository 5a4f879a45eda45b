"""Registered guarded-SQL jobs (G1q-G5q) over the test bed."""

from __future__ import annotations

from shiprisk.operators import sqlguard
from shiprisk.schemas import TABLE_NAMES
from shiprisk.session import apply_defaults
from shiprisk.sources import silver, testbed


def _statements(s, d):
    apply_defaults(s)
    return sqlguard.statement_log(s.read.parquet(f"{d}/events.parquet"))


def extract_sql(s, d):
    return _statements(s, d).select("event_id", sqlguard.extract_sql("raw_text").alias("sql_text"))


def guard_verdict(s, d):
    return _statements(s, d).select(
        "event_id", sqlguard.guard_verdict(sqlguard.extract_sql("raw_text")).alias("verdict"))


def statement_check(s, d):
    """Every statement accepted, or refused with the reason."""
    return _statements(s, d).select(
        "event_id", sqlguard.statement_check(sqlguard.extract_sql("raw_text")).alias("verdict"))


GUARDED_EXAMPLE = """```sql
SELECT p.product_name, s.shipping_mode, count(*) AS total_shipments,
       sum(s.late_delivery_risk) AS late_shipments
FROM order_items oi
JOIN products p ON oi.product_card_id = p.product_card_id
JOIN shipments s ON oi.order_item_id = s.order_item_id
GROUP BY p.product_name, s.shipping_mode;
```"""


def _guarded(s, d):
    apply_defaults(s)
    t = silver.testbed_silver(s, d).relational()
    # Tables that the statement doesn't name needn't be written for it.
    unread = testbed.tables(s, d, with_flat=False)
    views = {n: t.table(n) if n in GUARDED_EXAMPLE else unread.table(n) for n in TABLE_NAMES}
    return sqlguard.run_guarded(s, GUARDED_EXAMPLE, views)


def guarded_sql(s, d):
    return _guarded(s, d)


def preview(s, d):
    return sqlguard.preview(_guarded(s, d))


def guard_queries() -> dict:
    return {"extract_sql": extract_sql, "guard_verdict": guard_verdict,
            "statement_check": statement_check,
            "guarded_sql": guarded_sql, "preview": preview}
