"""The six relational tables and the join paths between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiprisk.functions.calendar import MONTH_NO
from shiprisk.schemas import TABLE_COLUMNS

# products.product_price clashes with order_items.product_price in the star.
_STAR_RENAMES = {("products", "product_price"): "catalog_price"}

ITEM_GRAIN = {"order_items", "shipments"}


@dataclass(frozen=True)
class SupplyTables:
    """categories, products, customers, orders, order_items, shipments.

    ``flat`` is the silver flat table (one row per order item) when the six
    tables are its projections.  Item-grain star views are then read straight
    from it instead of re-joining the 1:1 item/shipment pair.  This equals
    the joins under the key contract: unique keys, every item shipped, no
    orphan foreign keys -- what ``pk_violations`` / ``fk_orphans`` audit.
    ``relational()`` gives the join path when that is not guaranteed.
    """

    categories: DataFrame
    products: DataFrame
    customers: DataFrame
    orders: DataFrame
    order_items: DataFrame
    shipments: DataFrame
    flat: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    def as_dict(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in TABLE_COLUMNS}

    def relational(self) -> "SupplyTables":
        """The same tables with the flat shortcut switched off."""
        return SupplyTables(*(self.table(n) for n in TABLE_COLUMNS))

    def star(self, *parts: str) -> DataFrame:
        """Inner-join view over the named tables (star column names)."""
        wanted = set(parts)
        unknown = wanted - set(TABLE_COLUMNS)
        if unknown:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        if wanted & ITEM_GRAIN and self.flat is not None:
            return _star_from_flat(self.flat, wanted)
        return star_join(self, wanted)


def _star_name(table: str, column: str) -> str:
    return _STAR_RENAMES.get((table, column), column)


def _star_from_flat(flat: DataFrame, wanted: set[str]) -> DataFrame:
    cols, seen = [], set()
    for table in TABLE_COLUMNS:
        if table not in wanted and table not in ITEM_GRAIN:
            continue
        for out, src in TABLE_COLUMNS[table]:
            name = _star_name(table, out)
            if name in seen or src not in flat.columns:
                continue
            seen.add(name)
            cols.append(F.col(src).alias(name))
    return flat.select(*cols, *[c for c in (MONTH_NO,) if c in flat.columns])


def star_join(tables: SupplyTables, wanted: set[str] | None = None) -> DataFrame:
    """Relational path: chain of inner equi-joins on the declared keys.

    Join strategy is left to the planner: dimensions below the broadcast
    threshold (static estimate, or measured size under AQE) are broadcast,
    anything larger falls back to a sort-merge join.
    """
    wanted = set(TABLE_COLUMNS) if wanted is None else set(wanted)
    if wanted == {"shipments"}:
        return tables.shipments
    if wanted <= {"orders", "customers"}:
        base = tables.orders
        if "customers" in wanted:
            base = base.join(tables.customers, "customer_id")
        return base
    if wanted == {"products", "categories"} or wanted == {"products"}:
        base = tables.products.withColumnRenamed("product_price", "catalog_price")
        if "categories" in wanted:
            base = base.join(tables.categories, "category_id")
        return base
    base = tables.order_items
    if "shipments" in wanted:
        base = base.join(tables.shipments, "order_item_id")
    if wanted & {"orders", "customers"}:
        orders = tables.orders
        if "customers" in wanted:  # before the lines, which are then shuffled once for both
            orders = orders.join(tables.customers, "customer_id")
        base = base.join(orders, "order_id")
    if wanted & {"products", "categories"}:
        products = tables.products.withColumnRenamed("product_price", "catalog_price")
        base = base.join(products, "product_card_id")
    if "categories" in wanted:
        base = base.join(tables.categories, "category_id")
    return base
