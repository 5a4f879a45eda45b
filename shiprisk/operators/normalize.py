"""Split the cleaned frame into the six relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shiprisk.model import SupplyTables
from shiprisk.operators.clean import dedupe_by_key, drop_pii, project_rename
from shiprisk.schemas import DEDUPE_ORDER, DEDUPED_TABLES, PRIMARY_KEYS, TABLE_COLUMNS


def table_from_cleaned(cleaned: DataFrame, table: str, order_by: str = DEDUPE_ORDER) -> DataFrame:
    """One table: projection with renames; dimensions keep the first row per key."""
    pairs = TABLE_COLUMNS[table]
    if table not in DEDUPED_TABLES:
        return project_rename(cleaned, pairs)
    projected = project_rename(cleaned, pairs + [("__order", order_by)])
    kept = dedupe_by_key(projected, PRIMARY_KEYS[table], "__order")
    return kept.select(*[out for out, _ in pairs])


def normalize(cleaned: DataFrame, order_by: str = DEDUPE_ORDER,
              keep_flat: bool = True) -> SupplyTables:
    """categories, products, customers, orders (first row per key) and the
    order_items and shipments projections (not deduplicated).

    ``cleaned`` should be materialised once (a written silver table or a
    checkpoint) when several tables are built from it; each table is a lazy
    plan over it.  With ``keep_flat`` the flat (PII-free) frame is attached
    so item-grain reports avoid re-joining the 1:1 item/shipment pair.
    """
    parts = {t: table_from_cleaned(cleaned, t, order_by) for t in TABLE_COLUMNS}
    return SupplyTables(**parts, flat=drop_pii(cleaned) if keep_flat else None)
