"""Checks on the grain and values of the order-item table."""

from pyspark.sql import functions as F

from marketlens.functions.columns import money, money_sum


def value_checks():
    """The checks that look at one row at a time, as aggregates without a shuffle of their own."""
    price, freight = F.col("item_price"), F.col("freight_value")
    score = F.col("average_review_score")
    return [
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(money(money_sum("item_price")), F.lit(0.0)).alias("item_revenue"),
        F.coalesce(money(money_sum("freight_value")), F.lit(0.0)).alias("freight_revenue"),
        F.count_if(F.col("order_id").isNull()).alias("null_order_ids"),
        F.count_if(F.col("order_item_id").isNull()).alias("null_order_item_ids"),
        F.count_if(F.col("product_id").isNull()).alias("null_product_ids"),
        F.count_if((price < 0) | (freight < 0) | (F.col("item_total_value") < 0)).alias(
            "invalid_prices"
        ),
        F.count_if((score < 1) | (score > 5)).alias("invalid_review_scores"),
        F.count_if(F.col("delivery_days") < 0).alias("invalid_delivery_days"),
    ]


def _key_checks(df):
    # Keys first, then orders: both counts come out of one chain of partial aggregates.
    keys = df.groupBy("order_id", "order_item_id").agg(F.count(F.lit(1)).alias("copies"))
    orders = keys.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("keys"),
        F.sum("copies").alias("rows"),
        F.count_if(F.col("copies") > 1).alias("repeated"),
    )
    return orders.agg(
        F.coalesce(F.sum("keys"), F.lit(0)).alias("unique_order_item_keys"),
        F.coalesce(F.sum("repeated"), F.lit(0)).alias("duplicate_order_item_keys"),
        F.count("order_id").alias("distinct_orders"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("keyed_rows"),
    )


REPORT = [
    "row_count",
    "unique_order_item_keys",
    "duplicate_order_item_keys",
    "distinct_orders",
    "item_revenue",
    "freight_revenue",
    "null_order_ids",
    "null_order_item_ids",
    "null_product_ids",
    "invalid_prices",
    "invalid_review_scores",
    "invalid_delivery_days",
]


def validate(df):
    """One row with twelve measures and `grain_is_valid`.

    Two passes: one that only aggregates, and one that shuffles nothing but the two key columns.
    """
    # Each side has one row and its own columns; the maximum over both puts them in one row.
    both = df.agg(*value_checks()).unionByName(_key_checks(df), allowMissingColumns=True)
    return _graded(both.agg(*[F.max(name).alias(name) for name in REPORT]))


def report_of_write(stored, observed):
    """The report of `validate` for a table whose value checks were observed while it was written.

    Only its two key columns are read. That read counts the rows again: where the numbers differ,
    a task of the write was run, and so observed, more than once, and everything is read instead.
    """
    keys = _key_checks(stored).first()
    if keys["keyed_rows"] != observed["row_count"]:
        return validate(stored)
    values = {**observed, **keys.asDict()}
    kinds = {f.name: f.dataType for f in stored.agg(*value_checks()).schema.fields}
    one = [F.lit(values[name]).cast(kinds.get(name, "bigint")).alias(name) for name in REPORT]
    return _graded(stored.sparkSession.range(1).select(*one))


def _graded(report):
    grain = (
        (F.col("row_count") == F.col("unique_order_item_keys"))
        & (F.col("duplicate_order_item_keys") == 0)
        & (F.col("null_order_ids") == 0)
        & (F.col("null_order_item_ids") == 0)
    )
    return report.withColumn("grain_is_valid", grain)


# Measures that are counts of faults; the others are sizes and totals.
FAULTS = [
    "duplicate_order_item_keys",
    "null_order_ids",
    "null_order_item_ids",
    "null_product_ids",
    "invalid_prices",
    "invalid_review_scores",
    "invalid_delivery_days",
]


def validation_checks(report):
    """The report as rows (check, value, passed); `passed` is NULL for sizes and totals."""
    checks = [
        F.struct(
            F.lit(name).alias("check"),
            F.col(name).cast("double").alias("value"),
            (F.col(name) == 0 if name in FAULTS else F.lit(None).cast("boolean")).alias("passed"),
        )
        for name in REPORT
    ]
    grain = F.col("grain_is_valid")
    checks.append(
        F.struct(
            F.lit("grain_is_valid").alias("check"),
            grain.cast("int").cast("double").alias("value"),
            grain.alias("passed"),
        )
    )
    return report.select(F.inline(F.array(*checks)))


def require_valid(df, fail_on=("grain_is_valid",)):
    """Raise if one of the named checks fails, else return the table unchanged."""
    row = validation_checks(validate(df)).filter(F.col("check").isin(list(fail_on)))
    failed = [r["check"] for r in row.filter(~F.col("passed")).collect()]
    if failed:
        raise ValueError(f"Failed checks: {sorted(failed)}")
    return df
