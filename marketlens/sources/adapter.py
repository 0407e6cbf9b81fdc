"""The star-schema test tables re-expressed as the seven source tables.

Every rule is a projection of one table (customers: of two), so it needs no shuffle. The rules
leave gaps on purpose: orders without payments, reviews, purchase time or estimate, customers
and products that are missing, items without a seller.
"""

from pyspark.sql import functions as F


def staging_from_star_schema(spark, folder):
    orders, lineitem, customer, nation, part = (
        spark.read.parquet(f"{folder}/{name}.parquet")
        for name in ("orders", "lineitem", "customer", "nation", "part")
    )
    return {
        "orders": _orders(orders),
        "order_items": _order_items(lineitem),
        "customers": _customers(customer, nation),
        "products": _products(part),
        "payments": _payments(orders),
        "reviews": _reviews(orders),
        "category_translation": _category_translation(part),
    }


def _orders(orders):
    key = F.col("o_orderkey")
    placed = F.col("o_orderdate")
    purchased = F.when(key % 211 != 0, placed)
    open_order = F.col("o_orderstatus") == "P"

    def after(days, hours):
        return placed + F.make_dt_interval(days.cast("int"), hours.cast("int"))

    return orders.select(
        key.cast("string").alias("order_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_orderstatus").alias("order_status"),
        purchased.alias("order_purchase_timestamp"),
        purchased.alias("order_approved_at"),
        F.when(~open_order, purchased).alias("order_delivered_carrier_date"),
        F.when(~open_order, after((key * 7) % 41, key % 24)).alias(
            "order_delivered_customer_date"
        ),
        F.when(key % 97 != 0, after((key * 3 + 11) % 15 + 12, F.lit(0))).alias(
            "order_estimated_delivery_date"
        ),
    )


def _order_items(lineitem):
    # The line numbers repeat within an order, so the item number also carries price and quantity.
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    quantity = F.col("l_quantity").cast("bigint")
    return lineitem.select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        ((cents * 100 + quantity) * 10 + F.col("l_linenumber")).alias("order_item_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.when(F.col("l_suppkey") % 33 != 3, F.col("l_suppkey").cast("string")).alias("seller_id"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("freight_value"),
    )


def _customers(customer, nation):
    return (
        customer.filter(F.col("c_custkey") % 41 != 7)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").cast("string").alias("customer_id"),
            F.col("c_name").alias("customer_unique_id"),
            F.col("c_mktsegment").alias("customer_city"),
            F.col("n_name").alias("customer_state"),
        )
    )


def _products(part):
    return part.filter(F.col("p_partkey") % 37 != 5).select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.when(F.col("p_partkey") % 50 != 0, F.col("p_type")).alias("product_category_name"),
    )


def _payments(orders):
    key = F.col("o_orderkey")
    total = F.col("o_totalprice").cast("decimal(18,2)")
    first = F.when(key % 5 == 0, F.round(total / 2, 2).cast("decimal(18,2)")).otherwise(total)
    kinds = F.array(*[F.lit(k) for k in ("credit_card", "voucher", "boleto", "debit_card")])

    def record(kind, installments, value):
        return F.struct(
            F.element_at(kinds, (kind + 1).cast("int")).alias("payment_type"),
            installments.cast("int").alias("payment_installments"),
            value.cast("double").alias("payment_value"),
        )

    one = record(key % 4, key % 10 + 1, first)
    two = record((key + 1) % 4, F.lit(1), total - first)
    records = F.when(key % 5 == 0, F.array(one, two)).otherwise(F.array(one))
    return orders.filter(key % 53 != 0).select(
        key.cast("string").alias("order_id"), F.inline(records)
    )


def _reviews(orders):
    key = F.col("o_orderkey")
    one = ((key * 13) % 5 + 1).cast("int")
    two = ((key * 11) % 4 + 1).cast("int")
    scores = F.when(key % 50 == 0, F.array(one, two)).otherwise(F.array(one))
    return orders.filter(key % 7 != 0).select(
        key.cast("string").alias("order_id"), F.explode(scores).alias("review_score")
    )


def _category_translation(part):
    return (
        part.select(F.col("p_type").alias("product_category_name"))
        .filter(F.col("product_category_name").isin("ECONOMY", "LARGE", "PROMO", "SMALL"))
        .distinct()
        .withColumn(
            "product_category_name_english",
            F.concat(F.lower("product_category_name"), F.lit("_goods")),
        )
    )


# Questions as a person might type them, one per order; the names in braces are filled in from
# the order date.
QUESTION_TEMPLATES = (
    "Show me the main business KPIs.",
    "How has monthly revenue changed?",
    "Which product categories make the most revenue?",
    "Which states generate the most revenue?",
    "Which state has the worst delivery performance?",
    "How do late deliveries affect review scores?",
    "Why did monthly revenue decline?",
    "What will revenue be next year?",
    "Why did revenue drop in {ym}?",
    "What caused the sales change in {name} {year}?",
    "  WHAT   drove income in {name}? ",
    "   ",
    "What about states?",
    "and the categories",
    "How about {name} {year}?",
    "What drove that?",
    "aov",
    "What about the order volume in {ym}?",
    "delivery performance",
    "How about reviews",
    "why did that happen",
    "in that case, compare them",
    "Give me an overview of the business",
    "Did shipping delay hurt ratings?",
    "Maybe the region explains sales growth",
    "Who is the best seller?",
    "What about it?",
    "Reason for the decline of revenue in May",
    "reviews",
)


def _fill(template, date):
    # Year and month by way of numbers; the English name comes from the fixed locale of Spark.
    text = template
    for name, pattern in (("ym", "yyyy-MM"), ("year", "yyyy"), ("name", "MMMM")):
        text = F.replace(text, F.lit("{" + name + "}"), F.date_format(date, pattern))
    return text


def questions_from_star_schema(spark, folder):
    """Questions (question_id, conv_id, turn, question): an order is a turn of its customer."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    key = F.col("o_orderkey")
    # Bits of the key are mixed, so that neighbouring orders of a customer differ.
    number = ((key * 31 + F.col("o_custkey") * 17) % len(QUESTION_TEMPLATES)).cast("int")
    template = F.get(F.array(*[F.lit(t) for t in QUESTION_TEMPLATES]), number)
    return orders.select(
        key.alias("question_id"),
        F.col("o_custkey").alias("conv_id"),
        key.alias("turn"),
        _fill(template, F.col("o_orderdate")).alias("question"),
    )


EXPLANATION_TEMPLATE = (
    "Direct answer: order {key} brought ${price} [metric:item_revenue] , see `【row:1】`.\n"
    "\n\n\n## Key evidence\n[row:{row}] \t and [metric:leading_state] !\n"
    "  **business interpretation** :  it cost \\$5 [METHOD:grain]\n"
    "Limitations\n[warning:1] [warning:{warning}] [metric: no_such_key] [rows:1-4]"
)


def explanation_from_order():
    """An explanation text with references, for a row of `orders`."""
    key = F.col("o_orderkey")
    text = F.lit(EXPLANATION_TEMPLATE)
    for name, value in (
        ("key", key.cast("string")),
        ("price", F.col("o_totalprice").cast("decimal(18,2)").cast("string")),
        ("row", (key % 13).cast("string")),
        ("warning", (key % 5).cast("string")),
    ):
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return text
