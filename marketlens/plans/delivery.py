"""Delivery and review scorecards.

Medians here are exact: the aggregate keeps one counter per distinct value of a group, and a
delivery time or delay in whole days has few of those however many orders there are.
"""

from pyspark.sql import functions as F

from marketlens.functions.columns import (
    delay_band_label,
    delay_band_order,
    money,
    money_sum,
    percent_true,
    percentage,
    round2,
)
from marketlens.functions.guards import require_positive
from marketlens.operators.reduce import reduce_to

def _review_counts():
    orders, reviewed = F.count(F.lit(1)), F.count("average_review_score")
    return [
        orders.alias("order_count"),
        reviewed.alias("reviewed_order_count"),
        percentage(reviewed, orders).alias("review_coverage_percentage"),
    ]


def _average_and_median(column, noun):
    return [
        round2(F.avg(column)).alias(f"average_{noun}"),
        round2(F.median(column)).alias(f"median_{noun}"),
    ]


def _average_score():
    return round2(F.avg("average_review_score")).alias("average_review_score")


def delivery_scorecard(units, dimension, minimum_order_count):
    """Ten measures per dimension value over units (one row per order and value), worst first."""
    return (
        units.filter(F.col(dimension).isNotNull())
        .groupBy(dimension)
        .agg(
            *_review_counts(),
            *_average_and_median("delivery_days", "delivery_days"),
            percent_true("is_late_delivery").alias("late_delivery_rate_percentage"),
            round2(F.avg("delivery_delay_days")).alias("average_delay_days"),
            round2(F.avg(F.when(F.col("is_late_delivery"), F.col("delivery_delay_days")))).alias(
                "average_late_days_among_late_orders"
            ),
            _average_score(),
        )
        .filter(F.col("order_count") >= minimum_order_count)
        .orderBy(
            F.desc_nulls_last("late_delivery_rate_percentage"),
            F.desc("order_count"),
            dimension,
        )
    )


SCORED = ["delivery_days", "delivery_delay_days", "is_late_delivery", "average_review_score"]


def delivery_by_state(df, minimum_order_count=100):
    """States scored over orders; an order belongs to one state."""
    require_positive(minimum_order_count=minimum_order_count)
    orders = reduce_to(df, ["order_id"], SCORED + ["customer_state"])
    return delivery_scorecard(orders, "customer_state", minimum_order_count)


def _per_order_and(df, dimension):
    return reduce_to(df.filter(F.col(dimension).isNotNull()), ["order_id", dimension], SCORED)


def delivery_by_category(df, minimum_order_count=100):
    """Categories scored over orders; an order counts once in each of its categories."""
    require_positive(minimum_order_count=minimum_order_count)
    units = _per_order_and(df, "product_category")
    return delivery_scorecard(units, "product_category", minimum_order_count)


def worst_delivery_sellers(df, minimum_order_count=50, limit=10):
    """Sellers with the highest share of late orders."""
    require_positive(minimum_order_count=minimum_order_count, limit=limit)
    units = _per_order_and(df, "seller_id")
    return delivery_scorecard(units, "seller_id", minimum_order_count).limit(limit)


def late_and_on_time_orders(df):
    """One row for late and one for on-time orders; undelivered orders are left out."""
    return late_groups_of_orders(
        reduce_to(df, ["order_id"], ["delivery_days", "is_late_delivery", "average_review_score"])
    )


def late_groups_of_orders(orders):
    """The late and on-time groups of a table with one row per order."""
    late = F.col("is_late_delivery")
    status = F.when(late, F.lit("late")).otherwise(F.lit("on_time"))
    return (
        orders.filter(late.isNotNull())
        .groupBy(status.alias("delivery_status"))
        .agg(
            *_review_counts(),
            *_average_and_median("delivery_days", "delivery_days"),
            _average_score(),
        )
        .orderBy("delivery_status")
    )


def delivery_review_relationship(df):
    """Reviews per delay band, from much too early to much too late."""
    orders = reduce_to(df, ["order_id"], ["delivery_delay_days", "average_review_score"])
    return (
        orders.filter(F.col("delivery_delay_days").isNotNull())
        .groupBy(delay_band_order("delivery_delay_days").alias("band"))
        .agg(
            *_review_counts(),
            *_average_and_median("delivery_delay_days", "delay_days"),
            _average_score(),
        )
        .orderBy("band")
        .select(
            delay_band_label("band").alias("delivery_delay_band"),
            "order_count",
            "reviewed_order_count",
            "review_coverage_percentage",
            "average_delay_days",
            "median_delay_days",
            "average_review_score",
        )
    )


def state_overview(df, limit=10):
    """Largest states by revenue with freight, reviews and lateness.

    Items are reduced to order and state once; sums and order-level averages both come from
    that. Rows without a state form one group that has revenue but no order-level measures.
    """
    require_positive(limit=limit)
    orders = reduce_to(
        df,
        ["order_id", "customer_state"],
        ["is_late_delivery", "average_review_score"],
        revenue=money_sum("item_price"),
        freight=money_sum("freight_value"),
    )
    known = F.col("customer_state").isNotNull()
    return (
        orders.groupBy("customer_state")
        .agg(
            F.count("order_id").alias("order_count"),
            money(F.sum("revenue")).alias("item_revenue"),
            money(F.sum("freight")).alias("freight_revenue"),
            _average_score(),
            percent_true("is_late_delivery").alias("late_delivery_percentage"),
        )
        .withColumn("average_review_score", F.when(known, F.col("average_review_score")))
        .withColumn("late_delivery_percentage", F.when(known, F.col("late_delivery_percentage")))
        .orderBy(F.desc_nulls_last("item_revenue"), F.asc_nulls_last("customer_state"))
        .limit(limit)
    )
