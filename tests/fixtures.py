"""Hand-made relational tables with the edge rows of FIXTURES.md section 6."""

import datetime as dt
from decimal import Decimal as D

from shiprisk.model import SupplyTables
from shiprisk.schemas import contract


def ts(*a):
    return dt.datetime(*a)


CATEGORIES = [(1, "Electronics", 10, "Technology"), (2, "Electronics", 20, "Home"),
              (3, "Toys ", 30, "Kids")]
PRODUCTS = [(100, "Phone ", D("59.99"), 0, 1), (101, "Lamp", D("20.00"), 0, 2),
            (102, "Ball", D("5.00"), 1, 3), (103, "Orphan", D("1.00"), 0, 99)]
CUSTOMERS = [(1000, "Ana", "Lima", "x", "Consumer", "Rio", "RJ", "Rua 1", "Brazil", "2000"),
             (1001, "Bo", "Berg", "x", "Corporate", "Oslo", "OS", "Gate 2", "Norway", "0150")]
ORDERS = [
    (1, 1000, ts(2017, 10, 31, 23, 59), "COMPLETE", "South America", "RJ", "Rio", "Brazil", "2000",
     "LATAM", "DEBIT", D("-22.900000"), D("-43.200000")),
    (2, 1001, ts(2017, 11, 1, 0, 0), "COMPLETE", "Northern Europe", "OS", "Oslo", "Norway", "0150",
     "Europe", "CASH", D("59.900000"), D("10.700000")),
    (3, 1000, ts(2017, 8, 15, 9, 0), "PENDING", "South America", "RJ", "Rio", "Brazil", "UNKNOWN",
     "LATAM", "DEBIT", D("-22.900000"), D("-43.200000")),
    (4, 1001, ts(2017, 9, 10, 12, 0), "COMPLETE", "Northern Europe", "OS", "Oslo", "Norway", "0150",
     "Europe", "TRANSFER", D("59.900000"), D("10.700000")),
    (5, 1001, ts(2017, 9, 11, 12, 0), "COMPLETE", "Northern Europe", "OS", "Oslo", "Norway", "0150",
     "Europe", "TRANSFER", D("59.900000"), D("10.700000")),
]
# order_item_id, order_id, product, qty, price, discount, rate, ratio, sales, total, profit, benefit, spc
ITEMS = [
    (11, 1, 100, 1, D("59.99"), D("0.00"), D("0.0000"), D("0.1000"), D("59.99"), D("59.99"), D("6.00"), D("6.00"), D("59.99")),
    (12, 1, 101, 2, D("20.00"), D("4.00"), D("0.1000"), D("0.2000"), D("40.00"), D("36.00"), D("8.00"), D("8.00"), D("36.00")),
    (21, 2, 102, 4, D("5.00"), D("4.00"), D("0.2000"), D("-0.1000"), D("20.00"), D("16.00"), D("-2.00"), D("-2.00"), D("16.00")),
    (22, 2, 100, 1, D("59.99"), D("15.00"), D("0.2500"), D("0.0500"), D("59.99"), D("44.99"), D("3.00"), D("3.00"), D("44.99")),
    (41, 4, 101, 3, D("20.00"), D("0.00"), D("0.1001"), D("0.0000"), D("0.00"), D("0.00"), D("0.00"), D("0.00"), D("0.00")),
    (51, 5, 103, 1, D("1.00"), D("0.00"), D("0.0000"), D("0.0000"), D("1.00"), D("1.00"), D("1.00"), D("1.00"), D("1.00")),
    (99, 5, 100, 1, D("59.99"), D("0.00"), D("0.0000"), D("0.0000"), D("59.99"), D("59.99"), D("5.00"), D("5.00"), D("59.99")),
]
# item 99 has no shipment; item 51 has an unknown category (product 103 -> category 99)
SHIPMENTS = [
    (11, ts(2017, 11, 3, 0, 0), "Standard Class", "Late delivery", 5, 4, 1),
    (12, ts(2017, 11, 3, 0, 0), "Standard Class", "Advance shipping", 2, 4, 0),
    (21, ts(2017, 11, 2, 0, 0), "First Class", "Late delivery", 2, 1, 1),
    (22, ts(2017, 11, 2, 0, 0), "Same Day", "Shipping on time", 0, 0, 0),
    (41, ts(2017, 9, 12, 0, 0), "First Class", "Late delivery", 2, 1, 1),
    (51, ts(2017, 9, 12, 0, 0), "Second Class", "Late delivery", 3, 2, 1),
]


def tables(spark) -> SupplyTables:
    def mk(rows, name):
        return spark.createDataFrame(rows, contract(name))

    return SupplyTables(
        categories=mk(CATEGORIES, "categories"), products=mk(PRODUCTS, "products"),
        customers=mk(CUSTOMERS, "customers"), orders=mk(ORDERS, "orders"),
        order_items=mk(ITEMS, "order_items"), shipments=mk(SHIPMENTS, "shipments"))
