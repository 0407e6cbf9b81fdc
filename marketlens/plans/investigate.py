"""Month-over-month revenue change: components, drivers and the month a question means."""

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.functions.columns import (
    MONEY,
    money,
    money_sum,
    percent_change,
    percentage,
    ratio,
    round2,
)
from marketlens.functions.guards import (
    DIMENSIONS,
    require_columns,
    require_dimension,
    require_positive,
)
from marketlens.functions.text import normalize
from marketlens.plans.metrics import monthly_revenue, previous_month
from marketlens.session import stored

# Fixed values
MONTHS = (
    "january",
    "february",
    "march",
    "april",
    "may",
    "june",
    "july",
    "august",
    "september",
    "october",
    "november",
    "december",
)


def monthly_revenue_components(df, minimum_order_count=100):
    """Revenue, orders and revenue per order of complete months with their changes.

    The average order value here is rounded revenue over orders, unlike the mean of order sums
    in `metrics.average_order_value`. "Previous" is the previous complete month; it need not
    be the calendar month before, and `previous_month_start` says which one it is.
    """
    require_positive(minimum_order_count=minimum_order_count)
    months = monthly_revenue(df, minimum_order_count).withColumn(
        "average_order_value", round2(ratio("item_revenue", "order_count"))
    )
    measures = ["item_revenue", "order_count", "average_order_value"]
    paired = months.select(
        "purchase_month_start",
        *measures,
        *[previous_month(m).alias(f"previous_{m}") for m in measures],
        previous_month("purchase_month_start").alias("previous_month_start"),
    )

    def change(measure):
        return F.col(measure) - F.col(f"previous_{measure}")

    def change_percentage(measure):
        return percent_change(measure, f"previous_{measure}")

    return paired.select(
        "purchase_month_start",
        *measures,
        *[f"previous_{m}" for m in measures],
        round2(change("item_revenue")).alias("revenue_change_amount"),
        change_percentage("item_revenue").alias("revenue_change_percentage"),
        change("order_count").alias("order_count_change"),
        change_percentage("order_count").alias("order_count_change_percentage"),
        round2(change("average_order_value")).alias("average_order_value_change"),
        change_percentage("average_order_value").alias("average_order_value_change_percentage"),
        "previous_month_start",
    ).orderBy("purchase_month_start")


def comparable_months(components):
    """Complete months with a previous one: (purchase_month_start, previous_month_start)."""
    return components.filter(F.col("previous_month_start").isNotNull()).select(
        "purchase_month_start", "previous_month_start"
    )


def revenue_changes(df, months, dimensions=DIMENSIONS):
    """Revenue change per dimension and value for every month pair of `months`, in one scan.

    Each item counts once per dimension. Each month of revenue counts as "current" for its own
    target month and as "previous" for the next one. A value without sales in one of the two
    months counts as zero there. The result has a `change_rank` per target month and dimension:
    largest loss first if the total fell, else largest gain first.
    """
    for dimension in dimensions:
        require_dimension(dimension)
    month = F.col("purchase_month_start")
    roles = months.select(
        F.inline(
            F.array(
                F.struct(
                    month.alias("purchase_month_start"),
                    month.alias("target_month"),
                    F.lit(True).alias("is_current"),
                ),
                F.struct(
                    F.col("previous_month_start").alias("purchase_month_start"),
                    month.alias("target_month"),
                    F.lit(False).alias("is_current"),
                ),
            )
        )
    )
    cells = [
        F.struct(F.lit(d).alias("dimension"), F.col(d).alias("dimension_value"))
        for d in dimensions
    ]
    by_month = (
        df.select(month, "item_price", F.inline(F.array(*cells)))
        .filter(F.col("dimension_value").isNotNull())
        .groupBy(month, "dimension", "dimension_value")
        .agg(money_sum("item_price").alias("revenue"))
    )
    # roles has two rows per calendar month of data.
    paired = by_month.join(F.broadcast(roles), "purchase_month_start")
    current = F.col("is_current")
    sides = paired.groupBy("target_month", "dimension", "dimension_value").agg(
        _sum_or_zero(F.when(~current, F.col("revenue"))).alias("previous"),
        _sum_or_zero(F.when(current, F.col("revenue"))).alias("current"),
    )
    scope = ["target_month", "dimension"]
    return _changes(sides, Window.partitionBy(*scope), scope)


def _sum_or_zero(c):
    return F.coalesce(F.sum(c), F.lit(0).cast("decimal(38,4)")).cast("decimal(34,4)")


def _changes(sides, scope, keys):
    change, total = F.col("change"), F.col("total_change")
    amounts = (
        sides.withColumn("change", F.col("current") - F.col("previous"))
        .withColumn("total_change", F.sum("change").over(scope))
        .withColumn("change_amount", F.round("change", 2))
        .withColumn("total_rounded", F.sum("change_amount").over(scope))
    )
    falling_first = F.when(F.col("total_rounded") < 0, F.col("change_amount")).otherwise(
        -F.col("change_amount")
    )
    ranking = scope.orderBy(falling_first, "dimension_value")
    return amounts.select(
        *keys,
        "dimension_value",
        money("previous").alias("previous_revenue"),
        money("current").alias("current_revenue"),
        F.col("change_amount").cast("double").alias("change_amount"),
        percentage(change, "previous").alias("change_percentage"),
        percentage(change, total).alias("contribution_to_total_change_percentage"),
        F.row_number().over(ranking).alias("change_rank"),
    )


def revenue_change(df, dimension, current_month, previous_month):
    """Revenue change per dimension value between two months, main drivers first.

    Both month filters reach the scan; on the stored table they pick two folders.
    """
    require_dimension(dimension)
    month, price = F.col("purchase_month_start"), F.col("item_price").cast(MONEY)
    current, previous = (
        F.lit(str(m)).cast("timestamp_ntz") for m in (current_month, previous_month)
    )
    sides = (
        df.filter(month.isin(current, previous) & F.col(dimension).isNotNull())
        .groupBy(F.col(dimension).alias("dimension_value"))
        .agg(
            _sum_or_zero(F.when(month == previous, price)).alias("previous"),
            _sum_or_zero(F.when(month == current, price)).alias("current"),
        )
    )
    return (
        _changes(sides, Window.partitionBy(), [])
        .orderBy("change_rank")
        .drop("change_rank")
        .withColumnRenamed("dimension_value", dimension)
    )


def category_revenue_change(df, current_month, previous_month):
    return revenue_change(df, "product_category", current_month, previous_month)


def state_revenue_change(df, current_month, previous_month):
    return revenue_change(df, "customer_state", current_month, previous_month)


# A month reference becomes a key: "ym:2018-06", "my:6-2018", "m:6", or "decline" if the text
# names no month. The table of available keys then says which month, if any, is meant.
LARGEST_DECLINE = "decline"
YEAR_MONTH = r"\b(20\d{2})-(0[1-9]|1[0-2])\b"
YEAR = r"\b(20\d{2})\b"


def with_month_key(questions, wanted=None):
    """Add the `month_key` of the normalized questions, or of the `wanted` ones among them."""
    text = F.col("normalized_question")
    wanted = F.lit(True) if wanted is None else wanted
    # Most texts fail the plain search that comes before each pattern.
    named = F.coalesce(
        *[
            F.when(text.contains(name) & text.rlike(rf"(?U)\b{name}\b"), F.lit(number))
            for number, name in enumerate(MONTHS, 1)
        ]
    )

    def found(pattern, group):
        return F.when(text.contains("20"), F.regexp_extract(text, f"(?U){pattern}", group))

    year, number = F.col("_year"), F.col("_number")
    return (
        questions.withColumn("_year_month", F.when(wanted, found(YEAR_MONTH, 0)))
        .withColumn("_year", F.when(wanted, found(YEAR, 1)))
        .withColumn("_number", F.when(wanted, named))
        .withColumn(
            "month_key",
            F.when(F.col("_year_month") != "", F.concat(F.lit("ym:"), "_year_month"))
            .when(number.isNotNull() & (year != ""), F.concat(F.lit("my:"), number, F.lit("-"), year))
            .when(number.isNotNull(), F.concat(F.lit("m:"), number))
            .when(wanted, F.lit(LARGEST_DECLINE)),
        )
        .drop("_year_month", "_year", "_number")
    )


def month_key_text(question: str) -> str:
    """The month key of one text, for use inside a task."""
    text = question.strip().lower()
    found = re.search(YEAR_MONTH, text)
    if found:
        return f"ym:{found.group(0)}"
    year = re.search(YEAR, text)
    for number, name in enumerate(MONTHS, 1):
        if re.search(rf"\b{name}\b", text):
            return f"my:{number}-{year.group(1)}" if year else f"m:{number}"
    return LARGEST_DECLINE


def month_keys(components):
    """Every key that resolves, with its month; a month without a year means the latest."""
    require_columns(
        components,
        ["purchase_month_start", "previous_item_revenue", "revenue_change_percentage"],
    )
    month, growth = F.col("purchase_month_start"), F.col("revenue_change_percentage")
    number = F.month(month).cast("string")
    return (
        components.filter(F.col("previous_item_revenue").isNotNull() & growth.isNotNull())
        .select(
            month,
            growth,
            F.explode(
                F.array(
                    F.concat(F.lit("ym:"), F.date_format(month, "yyyy-MM")),
                    F.concat(F.lit("my:"), number, F.lit("-"), F.year(month)),
                    F.concat(F.lit("m:"), number),
                    F.lit(LARGEST_DECLINE),
                )
            ).alias("month_key"),
        )
        .groupBy("month_key")
        .agg(F.max(month).alias("latest"), F.min_by(month, F.struct(growth, month)).alias("worst"))
        .select(
            "month_key",
            F.when(F.col("month_key") == LARGEST_DECLINE, F.col("worst"))
            .otherwise(F.col("latest"))
            .alias("target_month"),
        )
    )


NOT_ENOUGH_MONTHS = "At least two complete months are required."
NOT_AVAILABLE = "The requested month is not available as a complete comparison month."


def resolve_target_months(questions, components, wanted=None):
    """Add month_key, target_month and month_error to a table of questions.

    With `wanted`, a condition on the questions, the others get NULLs. There are at most
    fourteen keys per twelve months of data and one more, so they are broadcast.
    """
    if "normalized_question" not in questions.columns:
        questions = questions.withColumn("normalized_question", normalize(F.col("question")))
    keyed = with_month_key(questions, wanted)
    resolved = keyed.join(F.broadcast(month_keys(components)), "month_key", "left")
    missing = F.when(F.col("month_key") == LARGEST_DECLINE, F.lit(NOT_ENOUGH_MONTHS)).otherwise(
        F.lit(NOT_AVAILABLE)
    )
    unresolved = F.col("month_key").isNotNull() & F.col("target_month").isNull()
    return resolved.withColumn("month_error", F.when(unresolved, missing))


# How the rows of each dimension are tagged.
SCOPES = {"product_category": "category_change", "customer_state": "state_change"}


def drivers(df, months, driver_limit=5):
    """The main drivers by category and by state of every month pair of `months`."""
    require_positive(driver_limit=driver_limit)
    is_category = F.col("dimension") == "product_category"
    scope = F.when(is_category, F.lit(SCOPES["product_category"])).otherwise(
        F.lit(SCOPES["customer_state"])
    )
    return (
        revenue_changes(df, months)
        .filter(F.col("change_rank") <= driver_limit)
        .withColumn("evidence_scope", scope)
        .drop("dimension")
    )


def investigate(df, questions, minimum_order_count=100, driver_limit=5):
    """Answer each question with its target month, that month's components and its drivers.

    One row per question and driver; a question whose month cannot be resolved, or has no
    drivers, keeps one row with `month_error` set or empty driver columns.
    """
    require_positive(minimum_order_count=minimum_order_count, driver_limit=driver_limit)
    # One row per month; stored, because three steps read it.
    components = stored(monthly_revenue_components(df, minimum_order_count), "monthly_components")
    found = drivers(df, comparable_months(components), driver_limit)
    # Both are small and bounded by the calendar: one row, and 2 x driver_limit rows, per month.
    return (
        resolve_target_months(questions, components)
        .join(
            F.broadcast(components.withColumnRenamed("purchase_month_start", "target_month")),
            "target_month",
            "left",
        )
        .join(F.broadcast(found), "target_month", "left")
    )
