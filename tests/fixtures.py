"""Hand-built order-item tables with known results."""

from datetime import datetime

JAN, FEB, MAR = (datetime(2024, m, 1) for m in (1, 2, 3))


def metrics_table(spark):
    return spark.createDataFrame(
        [
            ("order_1", 1, JAN, 40.0, 5.0, 5.0, False),
            ("order_1", 2, JAN, 60.0, 7.0, 5.0, False),
            ("order_2", 1, JAN, 50.0, 6.0, 1.0, True),
            ("order_3", 1, FEB, 150.0, 10.0, None, False),
        ],
        "order_id string, order_item_id int, purchase_month_start timestamp_ntz, "
        "item_price double, freight_value double, average_review_score double, "
        "is_late_delivery boolean",
    )


SEGMENTS = (
    "order_id string, order_item_id int, purchase_month_start timestamp_ntz, "
    "product_category string, customer_state string, item_price double"
)


def revenue_table(spark):
    return spark.createDataFrame(
        [
            ("order_1", 1, JAN, "electronics", "CA", 100.0),
            ("order_1", 2, JAN, "accessories", "CA", 50.0),
            ("order_2", 1, JAN, "electronics", "NY", 150.0),
            ("order_3", 1, FEB, "furniture", "CA", 300.0),
            ("order_4", 1, FEB, "electronics", "TX", 100.0),
            ("order_5", 1, MAR, "accessories", "TX", 100.0),
        ],
        SEGMENTS,
    )


def delivery_table(spark):
    return spark.createDataFrame(
        [
            ("order_1", 1, "CA", "electronics", "seller_a", 5, -3, False, 5.0),
            ("order_1", 2, "CA", "accessories", "seller_a", 5, -3, False, 5.0),
            ("order_2", 1, "CA", "electronics", "seller_b", 10, 2, True, 2.0),
            ("order_3", 1, "TX", "furniture", "seller_b", 15, 6, True, 1.0),
            ("order_4", 1, "TX", "electronics", "seller_a", 7, 0, False, 4.0),
            ("order_5", 1, "NY", "furniture", "seller_c", 20, 10, True, None),
            ("order_6", 1, "NY", "accessories", "seller_c", 4, -10, False, 5.0),
        ],
        "order_id string, order_item_id int, customer_state string, product_category string, "
        "seller_id string, delivery_days bigint, delivery_delay_days bigint, "
        "is_late_delivery boolean, average_review_score double",
    )


def investigation_table(spark):
    return spark.createDataFrame(
        [
            ("jan_1", 1, JAN, "electronics", "CA", 100.0),
            ("jan_2", 1, JAN, "electronics", "CA", 100.0),
            ("jan_3", 1, JAN, "furniture", "TX", 100.0),
            ("feb_1", 1, FEB, "electronics", "CA", 80.0),
            ("feb_2", 1, FEB, "furniture", "TX", 100.0),
            ("mar_1", 1, MAR, "electronics", "CA", 120.0),
            ("mar_2", 1, MAR, "furniture", "TX", 120.0),
        ],
        SEGMENTS,
    )


def evidence_table(spark):
    return spark.createDataFrame(
        [
            ("order_1", 1, "CA", "electronics", JAN, 100.0, 10.0, 5.0, 5, -3, False),
            ("order_1", 2, "CA", "accessories", JAN, 50.0, 5.0, 5.0, 5, -3, False),
            ("order_2", 1, "TX", "electronics", JAN, 150.0, 15.0, 2.0, 12, 3, True),
            ("order_3", 1, "CA", "furniture", FEB, 300.0, 20.0, 4.0, 7, 0, False),
            ("order_4", 1, "TX", "electronics", FEB, 200.0, 20.0, 1.0, 18, 8, True),
        ],
        "order_id string, order_item_id int, customer_state string, product_category string, "
        "purchase_month_start timestamp_ntz, item_price double, freight_value double, "
        "average_review_score double, delivery_days bigint, delivery_delay_days bigint, "
        "is_late_delivery boolean",
    )
