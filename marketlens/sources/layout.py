"""Staged tables kept in buckets of the order id, so that the table build joins without a shuffle.

`store_by_order` shuffles once; every later build reads the buckets side by side. The folder holds

    orders           orders with the columns of their customers
    order_items      items with their category, but those of hot orders
    hot_order_items  items of hot orders, in no buckets
    hot_orders       the hot orders and over how many salts each is spread
    payments         one summary per order
    reviews          one summary per order
    layout           one row, written last: its id, the number of buckets and of hot orders

An order has one bucket, and a bucket is one task. Payments and reviews of an order, however many,
are one row each. The items of an order that alone has more than half of an average bucket's rows
(`hot_keys`) would not fit beside others: they stay outside the buckets and are joined with salts,
as in `build_order_items`. Only these rows are shuffled again.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from marketlens.operators import model
from marketlens.operators.skew import SALT, hot_keys, listed, salt_rows
from marketlens.schema import ORDER_ITEMS

KEY = "order_id"
BUCKETED = ("orders", "order_items", "payments", "reviews")
LAYOUT = "layout_id string, buckets int, hot_orders bigint"


def _table_name(layout_id, name):
    # Spark knows buckets from its catalog only. A folder that is stored again has another id, so
    # no session takes its files for those of the buckets it knew.
    return f"by_order_{layout_id}_{name}"


def _store_bucketed(df, folder, layout_id, name, buckets):
    # One task per bucket, so one file per bucket, whatever the number of tasks before.
    dealt = df.filter(F.col(KEY).isNotNull()).repartition(buckets, KEY)
    writer = dealt.write.mode("overwrite").format("parquet").option("path", f"{folder}/{name}")
    writer.bucketBy(buckets, KEY).sortBy(KEY).saveAsTable(_table_name(layout_id, name))


def store_by_order(staging, folder, buckets=None, rows_per_salt=None):
    """Write the layout of the staged tables (a dict by logical name) to a folder of their own.

    `buckets` is the number of tasks of later builds, the number of shuffle partitions unless
    given: at scale, the bytes of the items over what one task is to sort. `rows_per_salt` is from
    how many items on an order is hot; half of an average bucket unless given. Rows without an
    order id join nothing and are left out. A store that fails leaves no layout that can be opened.
    """
    items = staging["order_items"].filter(F.col(KEY).isNotNull())
    spark = items.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if rows_per_salt is None:
        rows = items.agg(F.count(F.lit(1))).first()[0]
        rows_per_salt = max(1.0, rows / buckets / 2)
    hot = hot_keys(items, KEY, rows_per_salt)
    # Overwritten first: while the tables change, the folder has no finished layout.
    spark.createDataFrame([], LAYOUT).write.mode("overwrite").parquet(f"{folder}/layout")

    sold = model.item_side(
        salt_rows(items, hot, KEY), staging["products"], staging["category_translation"]
    )
    is_hot = listed(hot).select(KEY)
    sold.join(is_hot, KEY, "left_semi").write.mode("overwrite").parquet(f"{folder}/hot_order_items")
    hot.write.mode("overwrite").parquet(f"{folder}/hot_orders")
    plain = {
        "orders": model.with_customers(staging["orders"], staging["customers"]),
        "order_items": sold.join(is_hot, KEY, "left_anti").drop(SALT),
        "payments": model.payment_summary(staging["payments"]),
        "reviews": model.review_summary(staging["reviews"]),
    }
    layout_id = uuid.uuid4().hex
    for name in BUCKETED:
        _store_bucketed(plain[name], folder, layout_id, name, buckets)
    finished = spark.createDataFrame([(layout_id, buckets, hot.count())], LAYOUT)
    finished.coalesce(1).write.mode("overwrite").parquet(f"{folder}/layout")


def open_by_order(spark, folder):
    """The tables of a stored layout by name, and its number of hot orders, in any session."""
    try:
        row = spark.read.schema(LAYOUT).parquet(f"{folder}/layout").first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        row = None
    if row is None:
        raise FileNotFoundError(f"No finished layout: {folder}. Store it with store_by_order first.")
    opened = {
        "hot_orders": spark.read.parquet(f"{folder}/hot_orders"),
        "hot_order_items": spark.read.parquet(f"{folder}/hot_order_items"),
    }
    for name in BUCKETED:
        table, path = _table_name(row.layout_id, name), f"{folder}/{name}"
        if not spark.catalog.tableExists(table):
            columns = ", ".join(
                f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema
            )
            spark.sql(
                f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({KEY}) "
                f"SORTED BY ({KEY}) INTO {row.buckets} BUCKETS LOCATION :path",
                args={"path": path},
            )
        opened[name] = spark.table(table)
    return opened, row.hot_orders


def build_from_layout(spark, folder):
    """The order-item table, the same rows as `build_order_items` gives on the staged tables.

    Items, orders, payments and reviews meet bucket by bucket. If there are hot orders, their items
    are a second branch, joined with salts.
    """
    by_order, n_hot = open_by_order(spark, folder)
    orders = model.with_summaries(by_order["orders"], by_order["payments"], by_order["reviews"])
    orders = model.order_columns(orders)
    table = by_order["order_items"].join(orders, KEY).select(*ORDER_ITEMS.fieldNames())
    if not n_hot:
        return table
    hot = by_order["hot_orders"]
    # By default as many hot orders as tasks, twice, at most: few rows go to the salts.
    their_orders = orders.join(listed(hot).select(KEY), KEY, "left_semi")
    salted = model.salted_join(by_order["hot_order_items"], their_orders, hot)
    return table.unionByName(salted.select(*ORDER_ITEMS.fieldNames()))
