"""Schemas of the seven source tables and of the order-item table built from them."""

from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _struct(*fields):
    return StructType([StructField(name, kind(), True) for name, kind in fields])


# Only the columns the jobs read; further columns in a source are ignored.
SOURCES = {
    "orders": _struct(
        ("order_id", StringType),
        ("customer_id", StringType),
        ("order_status", StringType),
        ("order_purchase_timestamp", TimestampNTZType),
        ("order_approved_at", TimestampNTZType),
        ("order_delivered_carrier_date", TimestampNTZType),
        ("order_delivered_customer_date", TimestampNTZType),
        ("order_estimated_delivery_date", TimestampNTZType),
    ),
    "order_items": _struct(
        ("order_id", StringType),
        ("order_item_id", LongType),
        ("product_id", StringType),
        ("seller_id", StringType),
        ("price", DoubleType),
        ("freight_value", DoubleType),
    ),
    "customers": _struct(
        ("customer_id", StringType),
        ("customer_unique_id", StringType),
        ("customer_city", StringType),
        ("customer_state", StringType),
    ),
    "products": _struct(
        ("product_id", StringType),
        ("product_category_name", StringType),
    ),
    "payments": _struct(
        ("order_id", StringType),
        ("payment_type", StringType),
        ("payment_installments", IntegerType),
        ("payment_value", DoubleType),
    ),
    "reviews": _struct(
        ("order_id", StringType),
        ("review_score", IntegerType),
    ),
    "category_translation": _struct(
        ("product_category_name", StringType),
        ("product_category_name_english", StringType),
    ),
}

ORDER_ITEMS = _struct(
    ("order_id", StringType),
    ("order_item_id", LongType),
    ("customer_id", StringType),
    ("customer_unique_id", StringType),
    ("customer_city", StringType),
    ("customer_state", StringType),
    ("order_status", StringType),
    ("purchase_timestamp", TimestampNTZType),
    ("approved_timestamp", TimestampNTZType),
    ("delivered_carrier_timestamp", TimestampNTZType),
    ("delivered_customer_timestamp", TimestampNTZType),
    ("estimated_delivery_timestamp", TimestampNTZType),
    ("product_id", StringType),
    ("product_category", StringType),
    ("seller_id", StringType),
    ("item_price", DoubleType),
    ("freight_value", DoubleType),
    ("item_total_value", DoubleType),
    ("total_payment_value", DoubleType),
    ("max_payment_installments", IntegerType),
    ("payment_record_count", LongType),
    ("payment_types", StringType),
    ("average_review_score", DoubleType),
    ("review_count", LongType),
    ("delivery_days", LongType),
    ("estimated_delivery_days", LongType),
    ("delivery_delay_days", LongType),
    ("is_late_delivery", BooleanType),
    ("purchase_year", LongType),
    ("purchase_month", LongType),
    ("purchase_month_start", TimestampNTZType),
)

GRAIN = ["order_id", "order_item_id"]
