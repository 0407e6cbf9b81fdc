"""Build the order-item table: one row per (order_id, order_item_id), 31 columns."""

from pyspark.sql import functions as F

from marketlens.functions.columns import days_between, late_flag, money_sum, month_start
from marketlens.operators.skew import SALT, hot_keys, replicate_keyed, salt_rows
from marketlens.schema import ORDER_ITEMS


def payment_summary(payments):
    """Payments at order grain."""
    return payments.groupBy("order_id").agg(
        money_sum("payment_value").cast("double").alias("total_payment_value"),
        F.max("payment_installments").alias("max_payment_installments"),
        F.count(F.lit(1)).alias("payment_record_count"),
        # NULL, not an empty text, when no payment names its type
        F.nullif(
            F.array_join(F.array_sort(F.collect_set("payment_type")), ", "), F.lit("")
        ).alias("payment_types"),
    )


def review_summary(reviews):
    """Reviews at order grain."""
    return reviews.groupBy("order_id").agg(
        F.avg("review_score").alias("average_review_score"),
        F.count(F.lit(1)).alias("review_count"),
    )


def translated_products(products, translation):
    """Products with the English category, else the original one, else 'unknown'."""
    return products.join(translation, "product_category_name", "left").select(
        "product_id",
        F.coalesce(
            "product_category_name_english", "product_category_name", F.lit("unknown")
        ).alias("product_category"),
    )


def with_customers(orders, customers):
    known = customers.select("customer_id", "customer_unique_id", "customer_city", "customer_state")
    return orders.join(known, "customer_id", "left")


def with_summaries(orders, payments, reviews):
    """Orders with the summaries of their payments and reviews, at most one row of each."""
    return orders.join(payments, "order_id", "left").join(reviews, "order_id", "left")


def order_side(orders, customers, payments, reviews):
    """`base_columns` of the orders; each join adds at most one row per order."""
    # Customers first: what is then dealt by order_id stays there for the items.
    known = with_customers(orders, customers)
    return base_columns(with_summaries(known, payment_summary(payments), review_summary(reviews)))


def order_columns(per_order):
    """The columns of the order-item table that orders, customers and summaries bring."""
    return with_days(base_columns(per_order))


def base_columns(per_order):
    """As `order_columns`, without those that `with_days` makes of the others.

    Texts come last: the items of an order then agree in one long stretch of bytes.
    """
    purchased = F.col("order_purchase_timestamp").cast("timestamp_ntz")
    return per_order.select(
        month_start(purchased).alias("purchase_month_start"),
        purchased.alias("purchase_timestamp"),
        F.col("order_approved_at").cast("timestamp_ntz").alias("approved_timestamp"),
        F.col("order_delivered_carrier_date")
        .cast("timestamp_ntz")
        .alias("delivered_carrier_timestamp"),
        F.col("order_delivered_customer_date")
        .cast("timestamp_ntz")
        .alias("delivered_customer_timestamp"),
        F.col("order_estimated_delivery_date")
        .cast("timestamp_ntz")
        .alias("estimated_delivery_timestamp"),
        "total_payment_value",
        "max_payment_installments",
        "payment_record_count",
        "average_review_score",
        "review_count",
        "order_id",
        "customer_id",
        "customer_unique_id",
        "customer_city",
        "customer_state",
        "order_status",
        "payment_types",
    )


def with_days(rows):
    """Rows with `base_columns` and the columns that follow from their times."""
    purchased = F.col("purchase_timestamp")
    delivered = F.col("delivered_customer_timestamp")
    estimated = F.col("estimated_delivery_timestamp")
    return rows.select(
        "*",
        days_between(purchased, delivered).alias("delivery_days"),
        days_between(purchased, estimated).alias("estimated_delivery_days"),
        days_between(estimated, delivered).alias("delivery_delay_days"),
        late_flag(delivered, estimated).alias("is_late_delivery"),
        F.year(purchased).cast("bigint").alias("purchase_year"),
        F.month(purchased).cast("bigint").alias("purchase_month"),
    )


def item_side(order_items, products, translation):
    return with_total(base_items(order_items, products, translation))


def base_items(order_items, products, translation):
    """As `item_side`, without the total that `with_total` adds up."""
    salt = [SALT] if SALT in order_items.columns else []
    # Numbers before texts, as in `base_columns`.
    numbers = [*salt, F.col("freight_value").alias("freight"), "order_item_id", "price"]
    sold = order_items.select(*numbers, "seller_id", "product_id", "order_id")
    return sold.join(translated_products(products, translation), "product_id", "left").select(
        *salt, "freight", "order_item_id", "price", "seller_id", "product_id", "order_id", "product_category"
    )


def with_total(rows):
    """Rows with `base_items` and the three amounts; the types of the source add up first."""
    price, freight = F.col("price"), F.col("freight")
    return rows.select(
        *[c for c in rows.columns if c not in ("price", "freight")],
        price.cast("double").alias("item_price"),
        freight.cast("double").alias("freight_value"),
        (price + freight).cast("double").alias("item_total_value"),
    )


def build_order_items(staging, rows_per_salt=None, dealt_by=None):
    """The order-item table from the seven staging tables (a dict by logical name).

    Payments and reviews are brought to order grain before they are joined, so no join
    multiplies items. An order that holds very many items is spread over several tasks: its
    items are salted at the scan and its one order row is repeated per salt. Hot customers and
    products sit in the larger side of plain left joins, where the adaptive skew join splits
    them. Without such orders there are no salts: orders that the summaries have put in place by
    order_id meet their items there and are not shuffled again. The small sides carry no
    broadcast hint; their measured size decides. `rows_per_salt` overrides from how many items on
    an order is spread; see `hot_keys`. The columns that others give are computed last, so that no
    shuffle carries them: neither those of the joins nor the one that `dealt_by`, a column by which
    the rows are to be gathered, asks for.
    """
    items = staging["order_items"].filter(F.col("order_id").isNotNull())
    hot = hot_keys(items, "order_id", rows_per_salt)
    orders = order_side(
        staging["orders"].filter(F.col("order_id").isNotNull()),
        staging["customers"],
        staging["payments"],
        staging["reviews"],
    )
    catalog = staging["products"], staging["category_translation"]
    if hot.isEmpty():
        joined = base_items(items, *catalog).join(orders, "order_id")
    else:
        sold = base_items(salt_rows(items, hot, "order_id"), *catalog)
        joined = salted_join(sold, orders, hot)
    if dealt_by:
        # What the items of an order share comes first, at the same place in each of their rows.
        shared = [c for c in orders.columns if c in joined.columns]
        own = [c for c in joined.columns if c not in shared and c != SALT]
        joined = joined.select(*shared, *own).hint("rebalance", dealt_by)
    return with_days(with_total(joined)).select(*ORDER_ITEMS.fieldNames())


def salted_join(salted_items, orders, hot):
    """Items that carry a salt, joined to the rows of their orders."""
    return salted_items.join(replicate_keyed(orders, hot, "order_id"), ["order_id", SALT])
