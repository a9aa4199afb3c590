"""Canonical retail schema: bronze text layout and silver typing rules.

Bronze tables are all text so that a blank delivery date cannot make a
strict loader drop the row; silver casts with a blank→NULL guard where the
source may hold meaningful blanks.  Column typos in the source headers
(``lenght``) are kept on purpose so raw files load by header name.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: source table layouts (column names in header order) ---
BRONZE_COLUMNS: dict[str, list[str]] = {
    "orders": [
        "order_id", "customer_id", "order_status", "order_purchase_timestamp",
        "order_approved_at", "order_delivered_carrier_date",
        "order_delivered_customer_date", "order_estimated_delivery_date",
    ],
    "order_items": [
        "order_id", "order_item_id", "product_id", "seller_id",
        "shipping_limit_date", "price", "freight_value",
    ],
    "order_payments": [
        "order_id", "payment_sequential", "payment_type",
        "payment_installments", "payment_value",
    ],
    "order_reviews": [
        "review_id", "order_id", "review_score", "review_comment_title",
        "review_comment_message", "review_creation_date", "review_answer_timestamp",
    ],
    "products": [
        "product_id", "product_category_name", "product_name_lenght",
        "product_description_lenght", "product_photos_qty", "product_weight_g",
        "product_length_cm", "product_height_cm", "product_width_cm",
    ],
    "customers": [
        "customer_id", "customer_unique_id", "customer_zip_code_prefix",
        "customer_city", "customer_state",
    ],
    "sellers": [
        "seller_id", "seller_zip_code_prefix", "seller_city", "seller_state",
    ],
    "geolocation": [
        "geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng",
        "geolocation_city", "geolocation_state",
    ],
    "category_translation": [
        "product_category_name", "product_category_name_english",
    ],
}

TIMESTAMP = "timestamp_ntz"
MONEY = "decimal(18,2)"
MEASURE = "decimal(18,2)"
COORD = "decimal(18,14)"

# Silver typing: column -> (spark SQL type, blank-guarded).  Columns absent
# here stay text (ids, zip prefixes, free text, order_item_id, ...).
# The guard flags follow the source pipeline: strict casts where the source
# never has blanks, NULLIF-guarded casts where blanks are meaningful.
SILVER_TYPES: dict[str, dict[str, tuple[str, bool]]] = {
    "orders": {
        "order_purchase_timestamp": (TIMESTAMP, False),
        "order_approved_at": (TIMESTAMP, True),
        "order_delivered_carrier_date": (TIMESTAMP, True),
        "order_delivered_customer_date": (TIMESTAMP, True),
        "order_estimated_delivery_date": (TIMESTAMP, False),
    },
    "order_items": {
        "shipping_limit_date": (TIMESTAMP, False),
        "price": (MONEY, False),
        "freight_value": (MONEY, False),
    },
    "order_payments": {
        "payment_installments": ("int", False),
        "payment_value": (MONEY, False),
    },
    "order_reviews": {
        "review_score": ("int", False),
        "review_creation_date": (TIMESTAMP, True),
        "review_answer_timestamp": (TIMESTAMP, True),
    },
    "products": {
        "product_name_lenght": ("int", True),
        "product_description_lenght": ("int", True),
        "product_photos_qty": ("int", True),
        "product_weight_g": (MEASURE, True),
        "product_length_cm": (MEASURE, True),
        "product_height_cm": (MEASURE, True),
        "product_width_cm": (MEASURE, True),
    },
    "customers": {},
    "sellers": {},
    "category_translation": {},
    "geolocation": {
        "geolocation_lat": (COORD, True),
        "geolocation_lng": (COORD, True),
    },
}

# Text columns where a blank means "unknown" and becomes NULL in silver
# (the category NULL bucket depends on it).
SILVER_BLANK_TO_NULL: dict[str, list[str]] = {
    "products": ["product_category_name"],
}

# --- fixed values: Brazilian state code -> macro-region (27 codes, 5 regions) ---
REGION_OF_STATE: dict[str, list[str]] = {
    "North": ["AC", "AP", "AM", "PA", "RO", "RR", "TO"],
    "Northeast": ["AL", "BA", "CE", "MA", "PB", "PE", "PI", "RN", "SE"],
    "Central_West": ["DF", "GO", "MS", "MT"],
    "Southeast": ["ES", "MG", "RJ", "SP"],
    "South": ["PR", "RS", "SC"],
}
UNKNOWN_REGION = "unknown"


def bronze_schema(table: str) -> T.StructType:
    """All-text schema for a raw table (never inferred)."""
    return T.StructType([T.StructField(c, T.StringType(), True)
                         for c in BRONZE_COLUMNS[table]])
