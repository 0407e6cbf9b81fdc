"""Headline metrics. Each function returns a one-row DataFrame, the trend one row per month."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.functions.columns import (
    money,
    money_sum,
    percent_change,
    percent_true,
    ratio,
    round2,
)
from marketlens.operators.reduce import reduce_to


def _or_zero(c):
    return F.coalesce(c, F.lit(0.0))


def item_revenue(df):
    """Total item price, freight excluded."""
    return df.agg(_or_zero(money(money_sum("item_price"))).alias("item_revenue"))


def freight_value(df):
    return df.agg(_or_zero(money(money_sum("freight_value"))).alias("freight_value"))


def order_count(df):
    return df.agg(F.count_distinct("order_id").alias("order_count"))


def average_order_value(df):
    """Mean over orders of the order's item revenue."""
    return reduce_to(df, ["order_id"], revenue=money_sum("item_price")).agg(
        _average_order_value().alias("average_order_value")
    )


def _average_order_value():
    # An exact sum divided once, where an average of decimals would cut digits
    return _or_zero(round2(ratio(F.sum("revenue"), F.count("revenue"))))


def late_delivery_rate(df):
    """Per cent of delivered orders that came late."""
    return reduce_to(df, ["order_id"], ["is_late_delivery"]).agg(
        _or_zero(percent_true("is_late_delivery")).alias("late_delivery_rate_percentage")
    )


def average_review_score(df):
    """Mean score over reviewed orders."""
    return reduce_to(df, ["order_id"], ["average_review_score"]).agg(
        _or_zero(round2(F.avg("average_review_score"))).alias("average_review_score")
    )


def business_kpis(df):
    """The six headline metrics from one scan and one reduction to orders."""
    return kpis_of_orders(
        reduce_to(
            df,
            ["order_id"],
            ["is_late_delivery", "average_review_score"],
            revenue=money_sum("item_price"),
            freight=money_sum("freight_value"),
        )
    )


def kpis_of_orders(orders):
    """The headline metrics of a table with one row per order."""
    return orders.agg(
        _or_zero(money(F.sum("revenue"))).alias("item_revenue"),
        _or_zero(money(F.sum("freight"))).alias("freight_value"),
        F.count("order_id").alias("order_count"),
        _average_order_value().alias("average_order_value"),
        _or_zero(percent_true("is_late_delivery")).alias("late_delivery_rate_percentage"),
        _or_zero(round2(F.avg("average_review_score"))).alias("average_review_score"),
    )


def monthly_revenue(df, minimum_order_count=None):
    """Revenue and orders per month, unsorted; months below the minimum are left out."""
    months = (
        df.filter(F.col("purchase_month_start").isNotNull())
        .groupBy("purchase_month_start")
        .agg(
            money(money_sum("item_price")).alias("item_revenue"),
            F.count_distinct("order_id").alias("order_count"),
        )
    )
    if minimum_order_count is not None:
        months = months.filter(F.col("order_count") >= minimum_order_count)
    return months


# Windows without a partition run in one task. They only ever see one row per month or per
# dimension value, never item rows.
def previous_month(column):
    """The value of a column in the month before, in a table of months."""
    return F.lag(column).over(Window.orderBy("purchase_month_start"))


def with_growth(months):
    """Add growth in per cent over the row's previous month in the table."""
    return (
        months.withColumn("previous_month_revenue", previous_month("item_revenue"))
        .select(
            "purchase_month_start",
            "item_revenue",
            "order_count",
            percent_change("item_revenue", "previous_month_revenue").alias(
                "month_over_month_growth_percentage"
            ),
        )
        .orderBy("purchase_month_start")
    )


def monthly_revenue_trend(df):
    """All months, the incomplete first and last ones included."""
    return with_growth(monthly_revenue(df))
