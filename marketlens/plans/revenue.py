"""Revenue by segment and by complete month."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.functions.columns import money_sum, percentage
from marketlens.functions.guards import require_dimension, require_positive
from marketlens.plans.metrics import monthly_revenue, with_growth


def _segments(df, dimension):
    # The revenue stays a decimal here, so the total over segments is exact too. That total is
    # a window over one row per category or state.
    return (
        df.filter(F.col(dimension).isNotNull())
        .groupBy(dimension)
        .agg(
            F.round(money_sum("item_price"), 2).alias("revenue"),
            F.count_distinct("order_id").alias("order_count"),
        )
    )


def _with_share(segments, dimension):
    total = F.sum("revenue").over(Window.partitionBy())
    return segments.withColumn("total", total).select(
        dimension,
        F.col("revenue").cast("double").alias("item_revenue"),
        "order_count",
        percentage("revenue", "total").alias("revenue_share_percentage"),
    )


def _limited(df, limit):
    return df if limit is None else df.limit(limit)


def segment_revenue(df, dimension, limit=None):
    """Revenue, distinct orders and share of the total per known value, largest first."""
    require_dimension(dimension)
    require_positive(limit=limit)
    ranked = _with_share(_segments(df, dimension), dimension).orderBy(
        F.desc_nulls_last("item_revenue"), dimension
    )
    return _limited(ranked, limit)


def revenue_by_category(df, limit=None):
    return segment_revenue(df, "product_category", limit)


def revenue_by_state(df, limit=None):
    return segment_revenue(df, "customer_state", limit)


def top_revenue_categories(df, limit=10):
    return revenue_by_category(df, limit)


def bottom_revenue_categories(df, limit=10):
    """Smallest categories with revenue above zero; shares are of those categories' total."""
    require_positive(limit=limit)
    earning = _segments(df, "product_category").filter(F.col("revenue") > 0)
    return (
        _with_share(earning, "product_category")
        .orderBy("item_revenue", "product_category")
        .limit(limit)
    )


def complete_monthly_revenue(df, minimum_order_count=100):
    """Months with enough orders; growth is over the previous such month."""
    require_positive(minimum_order_count=minimum_order_count)
    return with_growth(monthly_revenue(df, minimum_order_count))


def largest_monthly_revenue_changes(df, minimum_order_count=100, limit=5):
    """Complete months with the largest growth or decline."""
    require_positive(minimum_order_count=minimum_order_count, limit=limit)
    growth = F.col("month_over_month_growth_percentage")
    return (
        complete_monthly_revenue(df, minimum_order_count)
        .filter(growth.isNotNull())
        .orderBy(F.abs(growth).desc(), "purchase_month_start")
        .limit(limit)
    )
