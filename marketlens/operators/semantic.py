"""What each column means and how it may be aggregated."""

from pyspark.sql import functions as F

from marketlens.functions.columns import money_sum, percent_true, round2
from marketlens.operators.median import exact_median, value_counts
from marketlens.operators.profile import column_counts, profile_table

SEMANTICS = (
    "column_name string, semantic_role string, entity string, business_meaning string, "
    "metric_grain string, allowed_aggregations array<string>, default_aggregation string, "
    "is_additive boolean, format string, warning string, is_primary_time_dimension boolean"
)

REPEATS = "Repeats on every item row of an order; take one value per order first."

# Aggregations by kind of column. The first is the default unless one is named.
KEY = ("count_distinct",)
DIMENSION = ("group_by", "count_distinct")
TIME = ("group_by_day", "group_by_month", "minimum", "maximum")
PURCHASE_TIME = (
    "group_by_day",
    "group_by_week",
    "group_by_month",
    "group_by_year",
    "minimum",
    "maximum",
)
AMOUNT = ("sum", "average", "minimum", "maximum", "median")
ORDER_SPAN = ("order_level_average", "minimum", "maximum", "median")


def _entry(role, entity, meaning, grain, allowed, default=None, **extra):
    return {
        "semantic_role": role,
        "entity": entity,
        "business_meaning": meaning,
        "metric_grain": grain,
        "allowed_aggregations": list(allowed),
        "default_aggregation": default or allowed[0],
        "is_additive": extra.pop("additive", False),
        "format": extra.pop("format", None),
        "warning": extra.pop("warning", None),
        "is_primary_time_dimension": extra.pop("primary", False),
    }


def _key(entity, meaning, grain):
    return _entry("identifier", entity, meaning, grain, KEY)


def _dimension(entity, meaning, grain="order"):
    return _entry("dimension", entity, meaning, grain, DIMENSION)


def _time(entity, meaning, allowed=TIME, default="group_by_month", **extra):
    return _entry("time_dimension", entity, meaning, "order", allowed, default, **extra)


def _item_amount(meaning):
    return _entry(
        "measure", "order_item", meaning, "order_item", AMOUNT, additive=True, format="currency"
    )


def _order_measure(entity, meaning, allowed, default="order_level_average", **extra):
    return _entry(
        "measure", entity, meaning, "order", allowed, default, warning=REPEATS, **extra
    )


# The columns of the table and what each of them is.
REGISTRY = {
    "order_id": _key("order", "Identifies an order.", "order"),
    "order_item_id": _entry(
        "identifier", "order_item", "Numbers an item within its order.", "order_item", ("count",)
    ),
    "customer_id": _key("customer_order_record", "The customer record of one order.", "order"),
    "customer_unique_id": _key("customer", "The same customer across orders.", "customer"),
    "customer_city": _dimension("geography", "City of the customer."),
    "customer_state": _dimension("geography", "State of the customer."),
    "order_status": _dimension("order", "Current or last status of the order."),
    "purchase_timestamp": _time(
        "order", "When the order was placed.", PURCHASE_TIME, primary=True
    ),
    "approved_timestamp": _time("order", "When the payment was approved."),
    "delivered_carrier_timestamp": _time("delivery", "When the carrier took over."),
    "delivered_customer_timestamp": _time("delivery", "When the customer got the order."),
    "estimated_delivery_timestamp": _time("delivery", "Delivery date promised at first."),
    "product_id": _key("product", "Identifies a product.", "product"),
    "product_category": _dimension("product", "Category in English.", "product"),
    "seller_id": _key("seller", "Identifies a seller.", "seller"),
    "item_price": _item_amount("Price of one item without freight."),
    "freight_value": _item_amount("Freight charged for one item."),
    "item_total_value": _item_amount("Price and freight of one item."),
    "total_payment_value": _order_measure(
        "order",
        "All payments of the order.",
        ("order_level_sum", "order_level_average", "minimum", "maximum"),
        "order_level_sum",
        format="currency",
    ),
    "max_payment_installments": _order_measure(
        "order", "Most installments of a payment.", ("order_level_average", "minimum", "maximum")
    ),
    "payment_record_count": _order_measure(
        "order",
        "Number of payment records.",
        ("order_level_sum", "order_level_average", "minimum", "maximum"),
    ),
    "payment_types": _dimension("payment", "Payment methods used."),
    "average_review_score": _order_measure(
        "order",
        "Mean review score of the order.",
        ("order_level_average", "minimum", "maximum"),
        format="rating_1_to_5",
    ),
    "review_count": _order_measure(
        "order", "Number of reviews.", ("order_level_sum", "order_level_average")
    ),
    "delivery_days": _order_measure(
        "delivery", "Days from purchase to delivery.", ORDER_SPAN, format="days"
    ),
    "estimated_delivery_days": _order_measure(
        "delivery", "Days from purchase to the estimate.", ORDER_SPAN, format="days"
    ),
    "delivery_delay_days": _order_measure(
        "delivery", "Days from estimate to delivery; above zero is late.", ORDER_SPAN, format="days"
    ),
    "is_late_delivery": _entry(
        "boolean_measure",
        "delivery",
        "Whether the order came after the estimate.",
        "order",
        ("order_level_percentage_true", "count_true"),
        warning=REPEATS,
    ),
    "purchase_year": _time("order", "Year of purchase.", ("group_by",), "group_by"),
    "purchase_month": _time("order", "Month of purchase, 1 to 12.", ("group_by",), "group_by"),
    "purchase_month_start": _time("order", "First day of the month of purchase.", ("group_by",), "group_by"),
}

TABLE_GRAIN = "One row is one purchased item of an order."
GRAIN_KEY = ("order_id", "order_item_id")
RULES = (
    "Item-level amounts such as item_price and freight_value may be summed over rows.",
    "Order-level values repeat on item rows; reduce to one row per order first.",
    "There is revenue but neither product cost nor profit.",
)


def column_registry(spark):
    """The known columns as a DataFrame, one row each."""
    rows = [{"column_name": name, **entry} for name, entry in REGISTRY.items()]
    return spark.createDataFrame(rows, SEMANTICS)


def fallback_semantics():
    """Semantics of an unknown column from its name, type and share of distinct values."""
    name, kind = F.col("column_name"), F.col("database_type")
    numeric = kind.rlike(r"^(tinyint|smallint|int|bigint|float|double|decimal\(\d+,\d+\))$")

    def inferred(role, default, *allowed):
        return F.struct(
            F.lit(role).alias("semantic_role"),
            F.lit("unknown").alias("entity"),
            F.concat(F.lit("Inferred from the data of "), name, F.lit(".")).alias(
                "business_meaning"
            ),
            F.lit("unknown").alias("metric_grain"),
            F.array(*[F.lit(a) for a in allowed]).alias("allowed_aggregations"),
            F.lit(default).alias("default_aggregation"),
            F.lit(False).alias("is_additive"),
            F.lit(None).cast("string").alias("format"),
            F.lit(None).cast("string").alias("warning"),
            F.lit(False).alias("is_primary_time_dimension"),
        )

    return (
        F.when(name.endswith("_id"), inferred("identifier", "count_distinct", "count_distinct"))
        .when(
            kind.rlike(r"^(date|timestamp|timestamp_ntz|time(\(\d+\))?)$"),
            inferred("time_dimension", "group_by", "group_by", "minimum", "maximum"),
        )
        .when(
            kind == "boolean",
            inferred("boolean_measure", "percentage_true", "percentage_true", "count_true"),
        )
        .when(numeric, inferred("measure", "average", "average", "minimum", "maximum", "median"))
        .when(
            F.col("cardinality_ratio") < 0.20,
            inferred("dimension", "group_by", "group_by", "count_distinct"),
        )
        .otherwise(inferred("attribute", "none", "count_distinct"))
    )


def enrich_profile(profile):
    """Add the semantics of every profiled column: registered ones, else inferred ones."""
    fields = [f.split()[0] for f in SEMANTICS.split(", ")][1:]
    registry = column_registry(profile.sparkSession).select(
        "column_name", F.struct(*fields).alias("_registered")
    )
    return (
        # One row per registered column
        profile.join(F.broadcast(registry), "column_name", "left")
        .withColumn("_semantics", F.coalesce("_registered", fallback_semantics()))
        .select(
            *profile.columns,
            "_semantics.*",
            F.when(F.col("_registered").isNotNull(), F.lit("business_registry"))
            .otherwise(F.lit("heuristic"))
            .alias("inference_source"),
            F.lit(TABLE_GRAIN).alias("table_grain"),
            F.array(*[F.lit(r) for r in RULES]).alias("important_rules"),
        )
    )


def build_semantic_metadata(df):
    """Profile of the order-item table with the meaning of every column."""
    return enrich_profile(profile_table(df)).orderBy("position")


def table_metadata(df, table_name):
    """One row about the table as a whole: its size, its grain and the rules for its use."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(table_name).alias("table_name"),
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(TABLE_GRAIN).alias("table_grain"),
        F.array(*[F.lit(c) for c in GRAIN_KEY]).alias("grain_key_columns"),
        F.array(*[F.lit(r) for r in RULES]).alias("important_rules"),
    )


def role_counts(metadata):
    return metadata.groupBy("semantic_role").agg(F.count(F.lit(1)).alias("columns"))


def aggregation_warnings(metadata):
    return metadata.filter(F.col("warning").isNotNull()).select("column_name", "warning")


def save_semantic_metadata(metadata, path):
    """Replace the metadata at `path` with JSON lines, one per column."""
    metadata.coalesce(1).write.mode("overwrite").json(path)


# The first day of the period a time falls into.
PERIODS = {
    "group_by_day": lambda c: c.cast("date"),
    "group_by_week": lambda c: F.trunc(c.cast("date"), "week"),
    "group_by_month": lambda c: F.trunc(c.cast("date"), "month"),
    "group_by_year": lambda c: F.trunc(c.cast("date"), "year"),
}

MEASURES = {
    "sum": lambda c: F.round(money_sum(c), 2).cast("double"),
    "order_level_sum": lambda c: F.round(money_sum(c), 2).cast("double"),
    "average": lambda c: round2(F.avg(c)),
    "order_level_average": lambda c: round2(F.avg(c)),
    "minimum": F.min,
    "maximum": F.max,
    "count": F.count,
    "count_distinct": F.count_distinct,
    "count_true": F.count_if,
    "order_level_percentage_true": percent_true,
    "percentage_true": percent_true,
}


def semantics_of(df, column):
    """The semantics of a column of `df`: registered, or inferred from its counts by one job."""
    if column in REGISTRY:
        return REGISTRY[column]
    if column not in df.columns:
        raise ValueError(f"There is no such column: {column}")
    counts = column_counts(df.select(column))
    return enrich_profile(counts).first().asDict()


def _allowed(entry, column, aggregation):
    aggregation = aggregation or entry["default_aggregation"]
    if aggregation not in entry["allowed_aggregations"]:
        raise ValueError(
            f"{aggregation} is not allowed for {column}; allowed: {entry['allowed_aggregations']}"
        )
    return aggregation


def _group(df, by):
    """(name, column) of a grouping given as a column name or as (name, aggregation)."""
    name, aggregation = by if isinstance(by, tuple) else (by, None)
    aggregation = _allowed(semantics_of(df, name), name, aggregation)
    if not aggregation.startswith("group_by"):
        raise ValueError(f"Cannot group by {name} with {aggregation}.")
    return name, PERIODS.get(aggregation, lambda c: c)(F.col(name)).alias(name)


def aggregate_metric(df, column, aggregation=None, by=()):
    """One column aggregated the way its semantics allow; column `value`, one row per group.

    Without `aggregation` the default one of the column is used. `by` lists dimensions; a time
    may be given as ("purchase_timestamp", "group_by_week"). A column at order grain is reduced
    to one value per order and group first. Rows without a group value are left out. A column
    that isn't registered has the semantics that its name, type and values suggest.
    """
    entry = semantics_of(df, column)
    aggregation = _allowed(entry, column, aggregation)
    if aggregation.startswith("group_by") or aggregation == "none":
        raise ValueError(f"{column} is a dimension; name it in `by` or choose an aggregation.")
    groups = [_group(df, b) for b in by]
    names = [name for name, _ in groups]
    at_order = entry["metric_grain"] == "order" and "measure" in entry["semantic_role"]
    key = ["order_id"] if at_order else []
    rows = df.select(*key, *[c for _, c in groups], F.col(column).alias("value"))
    for name in names:
        rows = rows.filter(F.col(name).isNotNull())
    if at_order:
        reduce = F.bool_or if entry["semantic_role"] == "boolean_measure" else F.max
        rows = rows.groupBy("order_id", *names).agg(reduce("value").alias("value"))
    if aggregation == "median":
        return exact_median(value_counts(rows, names, "value"), names).select(
            *names, round2("median").alias("value")
        )
    return rows.groupBy(*names).agg(MEASURES[aggregation]("value").alias("value"))
