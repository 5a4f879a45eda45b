"""Contracts: raw header names, cast lists, relational tables, keys.

The values under "FIXED VALUES" must equal the original project's for the
jobs to read its data and give the same answers; they are stated as text,
in their natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES: raw CSV header names of the order-line file, in file order
# (52 from the published data dictionary + "Order Zipcode").
# ---------------------------------------------------------------------------
RAW_HEADERS = [
    "Type",
    "Days for shipping (real)",
    "Days for shipment (scheduled)",
    "Benefit per order",
    "Sales per customer",
    "Delivery Status",
    "Late_delivery_risk",
    "Category Id",
    "Category Name",
    "Customer City",
    "Customer Country",
    "Customer Email",
    "Customer Fname",
    "Customer Id",
    "Customer Lname",
    "Customer Password",
    "Customer Segment",
    "Customer State",
    "Customer Street",
    "Customer Zipcode",
    "Department Id",
    "Department Name",
    "Latitude",
    "Longitude",
    "Market",
    "Order City",
    "Order Country",
    "Order Customer Id",
    "order date (DateOrders)",
    "Order Id",
    "Order Item Cardprod Id",
    "Order Item Discount",
    "Order Item Discount Rate",
    "Order Item Id",
    "Order Item Product Price",
    "Order Item Profit Ratio",
    "Order Item Quantity",
    "Sales",
    "Order Item Total",
    "Order Profit Per Order",
    "Order Region",
    "Order State",
    "Order Status",
    "Product Card Id",
    "Product Category Id",
    "Product Description",
    "Product Image",
    "Product Name",
    "Product Price",
    "Product Status",
    "shipping date (DateOrders)",
    "Shipping Mode",
    "Order Zipcode",
]

# FIXED VALUES: columns removed in silver (empty description, image, password).
JUNK_COLUMNS = ["product_description", "product_image", "customer_password"]

# FIXED VALUES: personal columns removed from the flat silver table.
PII_COLUMNS = ["customer_fname", "customer_lname", "customer_email", "customer_street"]

# FIXED VALUES: the silver cast lists (15 integer, 12 money/ratio columns).
INT_COLUMNS = [
    "days_for_shipping_real", "days_for_shipment_scheduled", "late_delivery_risk",
    "category_id", "customer_id", "customer_zipcode", "department_id",
    "order_customer_id", "order_id", "order_item_cardprod_id", "order_item_id",
    "order_item_quantity", "product_card_id", "product_category_id", "product_status",
]
# Row-level keys of the cast list: 64-bit, as line items pass 2**31 at scale.
KEY_COLUMNS = ["customer_id", "order_customer_id", "order_id", "order_item_cardprod_id", "order_item_id",
               "product_card_id"]
NUMERIC_COLUMNS = [
    "benefit_per_order", "sales_per_customer", "latitude", "longitude",
    "order_item_discount", "order_item_discount_rate", "order_item_product_price",
    "order_item_profit_ratio", "sales", "order_item_total", "order_profit_per_order",
    "product_price",
]

# Exact decimal types in place of doubles (sums independent of order; bucket
# edges of the discount rate fall on the stated side).
MONEY = T.DecimalType(10, 2)
RATE = T.DecimalType(6, 4)
RATIO = T.DecimalType(10, 4)
COORD = T.DecimalType(10, 6)

NUMERIC_TYPES = {
    "benefit_per_order": MONEY, "sales_per_customer": MONEY,
    "latitude": COORD, "longitude": COORD,
    "order_item_discount": MONEY, "order_item_discount_rate": RATE,
    "order_item_product_price": MONEY, "order_item_profit_ratio": RATIO,
    "sales": MONEY, "order_item_total": MONEY, "order_profit_per_order": MONEY,
    "product_price": MONEY,
}

# Raw timestamp columns -> silver names.
TIMESTAMP_COLUMNS = {
    "order_date_dateorders": "order_date",
    "shipping_date_dateorders": "shipping_date",
}

# Null fills of the cleaning step.
NULL_FILLS = {"order_zipcode": "UNKNOWN", "customer_lname": "UNKNOWN", "customer_zipcode": 0}

# FIXED VALUES: vocabularies of the source data.
SHIPPING_MODES = ["Standard Class", "First Class", "Second Class", "Same Day"]
DELIVERY_STATUSES = ["Advance shipping", "Late delivery", "Shipping canceled", "Shipping on time"]
DISCOUNT_BUCKETS = ["No Discount", "Low (0-10%)", "Medium (10-20%)", "High (20%+)"]

# ---------------------------------------------------------------------------
# Relational model: (output column, source column of the cleaned frame).
# ---------------------------------------------------------------------------
TABLE_COLUMNS = {
    "categories": [
        ("category_id", "category_id"), ("category_name", "category_name"),
        ("department_id", "department_id"), ("department_name", "department_name"),
    ],
    "products": [
        ("product_card_id", "product_card_id"), ("product_name", "product_name"),
        ("product_price", "product_price"), ("product_status", "product_status"),
        ("category_id", "category_id"),
    ],
    "customers": [
        ("customer_id", "customer_id"), ("first_name", "customer_fname"),
        ("last_name", "customer_lname"), ("email", "customer_email"),
        ("segment", "customer_segment"), ("city", "customer_city"),
        ("state", "customer_state"), ("street", "customer_street"),
        ("country", "customer_country"), ("zipcode", "customer_zipcode"),
    ],
    "orders": [
        ("order_id", "order_id"), ("customer_id", "order_customer_id"),
        ("order_date", "order_date"), ("order_status", "order_status"),
        ("order_region", "order_region"), ("order_state", "order_state"),
        ("order_city", "order_city"), ("order_country", "order_country"),
        ("order_zipcode", "order_zipcode"), ("market", "market"),
        ("payment_type", "type"), ("latitude", "latitude"), ("longitude", "longitude"),
    ],
    "order_items": [
        ("order_item_id", "order_item_id"), ("order_id", "order_id"),
        ("product_card_id", "order_item_cardprod_id"), ("quantity", "order_item_quantity"),
        ("product_price", "order_item_product_price"), ("discount", "order_item_discount"),
        ("discount_rate", "order_item_discount_rate"), ("profit_ratio", "order_item_profit_ratio"),
        ("sales", "sales"), ("order_item_total", "order_item_total"),
        ("profit_per_order", "order_profit_per_order"), ("benefit_per_order", "benefit_per_order"),
        ("sales_per_customer", "sales_per_customer"),
    ],
    "shipments": [
        ("order_item_id", "order_item_id"), ("shipping_date", "shipping_date"),
        ("shipping_mode", "shipping_mode"), ("delivery_status", "delivery_status"),
        ("days_for_shipping_real", "days_for_shipping_real"),
        ("days_for_shipment_scheduled", "days_for_shipment_scheduled"),
        ("late_delivery_risk", "late_delivery_risk"),
    ],
}

TABLE_NAMES = list(TABLE_COLUMNS)

PRIMARY_KEYS = {
    "categories": "category_id",
    "products": "product_card_id",
    "customers": "customer_id",
    "orders": "order_id",
    "order_items": "order_item_id",
    "shipments": "order_item_id",
}

# (child table, child column, parent table, parent column)
FOREIGN_KEYS = [
    ("products", "category_id", "categories", "category_id"),
    ("orders", "customer_id", "customers", "customer_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_card_id", "products", "product_card_id"),
    ("shipments", "order_item_id", "order_items", "order_item_id"),
]

# Dedupe rule of the dimension tables: key -> the cleaned-frame column whose
# smallest value marks the row that is kept (first line item of the key).
DEDUPE_ORDER = "order_item_id"
DEDUPED_TABLES = ["categories", "products", "customers", "orders"]

_S, _I, _L, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampNTZType()

# FIXED VALUES: declared column types of the six tables (the DDL contracts).
TABLE_TYPES = {
    "categories": {"category_id": _I, "category_name": _S, "department_id": _I, "department_name": _S},
    "products": {"product_card_id": _L, "product_name": _S, "product_price": MONEY,
                 "product_status": _I, "category_id": _I},
    "customers": {"customer_id": _L, "first_name": _S, "last_name": _S, "email": _S, "segment": _S,
                  "city": _S, "state": _S, "street": _S, "country": _S, "zipcode": _S},
    "orders": {"order_id": _L, "customer_id": _L, "order_date": _TS, "order_status": _S,
               "order_region": _S, "order_state": _S, "order_city": _S, "order_country": _S,
               "order_zipcode": _S, "market": _S, "payment_type": _S,
               "latitude": COORD, "longitude": COORD},
    "order_items": {"order_item_id": _L, "order_id": _L, "product_card_id": _L, "quantity": _I,
                    "product_price": MONEY, "discount": MONEY, "discount_rate": RATE,
                    "profit_ratio": RATIO, "sales": MONEY, "order_item_total": MONEY,
                    "profit_per_order": MONEY, "benefit_per_order": MONEY,
                    "sales_per_customer": MONEY},
    "shipments": {"order_item_id": _L, "shipping_date": _TS, "shipping_mode": _S,
                  "delivery_status": _S, "days_for_shipping_real": _I,
                  "days_for_shipment_scheduled": _I, "late_delivery_risk": _I},
}

# Columns declared NOT NULL besides the keys.
NOT_NULL = {t: [PRIMARY_KEYS[t]] for t in TABLE_NAMES}


def contract(table: str) -> T.StructType:
    """StructType of one relational table (keys not nullable)."""
    key = PRIMARY_KEYS[table]
    return T.StructType([
        T.StructField(name, dtype, nullable=(name != key))
        for name, dtype in TABLE_TYPES[table].items()
    ])


# Model input (M1): categorical and numeric features, target.
CATEGORICAL_FEATURES = ["shipping_mode", "order_region", "market", "category_name"]
NUMERIC_FEATURES = ["discount_rate", "quantity", "order_month", "order_weekday"]
LABEL = "late_delivery_risk"

# Columns known only after dispatch; never allowed as model inputs.
POST_DISPATCH_COLUMNS = [
    "delivery_status", "days_for_shipping_real", "shipping_date", "delay_days",
    "late_delivery_risk",
]

# FIXED VALUES: nine numeric columns of the correlation matrix (E4), flat silver names.
CORRELATION_COLUMNS = [
    "days_for_shipping_real", "days_for_shipment_scheduled", "benefit_per_order",
    "sales_per_customer", "late_delivery_risk", "order_item_discount_rate",
    "order_item_profit_ratio", "order_item_quantity", "sales",
]
