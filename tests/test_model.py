import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from marketlens.operators import model, quality, skew
from marketlens.schema import ORDER_ITEMS, SOURCES
from marketlens.sources import adapter, staging, tables


@pytest.fixture(scope="module")
def staged(spark, sf_dir):
    return adapter.staging_from_star_schema(spark, sf_dir)


@pytest.fixture(scope="module")
def built(staged):
    return model.build_order_items(staged)


def one_order(spark, **changes):
    at = datetime
    tables_ = {
        "orders": [
            ("o1", "c1", "delivered", at(2024, 1, 31, 23), None, None, at(2024, 2, 5, 9), at(2024, 2, 5))
        ],
        "order_items": [("o1", 1, "p1", "s1", 10.0, 1.5), ("o1", 2, "gone", "s1", 5.0, 0.5)],
        "customers": [("c1", "u1", "Town", "CA")],
        "products": [("p1", "a"), ("p2", None)],
        "payments": [("o1", "voucher", 1, 4.0), ("o1", "card", 3, 13.0), ("o1", "card", 2, 0.0)],
        "reviews": [("o1", 5), ("o1", 4)],
        "category_translation": [("a", "alpha")],
    }
    tables_.update(changes)
    return {n: spark.createDataFrame(rows, SOURCES[n]) for n, rows in tables_.items()}


def test_one_order(spark):
    rows = model.build_order_items(one_order(spark)).orderBy("order_item_id").collect()
    assert len(rows) == 2
    first = rows[0]
    assert first.payment_types == "card, voucher"
    assert (first.total_payment_value, first.max_payment_installments) == (17.0, 3)
    assert (first.payment_record_count, first.review_count) == (3, 2)
    assert first.average_review_score == 4.5
    # Five midnights, though less than five days of 24 hours
    assert (first.delivery_days, first.estimated_delivery_days) == (5, 5)
    # Later on the promised day: late with a delay of no days
    assert (first.delivery_delay_days, first.is_late_delivery) == (0, True)
    assert first.purchase_month_start == datetime(2024, 1, 1)
    assert (first.product_category, rows[1].product_category) == ("alpha", None)


def test_gaps(spark):
    at = datetime
    orders = [
        ("o1", "cx", "x", at(2024, 1, 1), None, None, at(2024, 1, 2), None),
        ("o2", "c1", "x", None, None, None, None, at(2024, 1, 2)),
        ("o3", "c1", "x", at(2024, 1, 1), None, None, None, None),
    ]
    items = [("o1", 1, "p2", "s1", 1.0, 1.0), ("o2", 1, "p2", None, 1.0, None)]
    rows = model.build_order_items(one_order(spark, orders=orders, order_items=items)).collect()
    o1, o2 = sorted(rows, key=lambda r: r.order_id)
    assert (o1.product_category, o1.customer_state, o1.is_late_delivery) == ("unknown", None, False)
    assert (o2.is_late_delivery, o2.purchase_month_start, o2.item_total_value) == (None, None, None)
    assert (o2.payment_types, o2.average_review_score) == (None, None)


def test_schema_and_grain(built):
    assert [(f.name, f.dataType) for f in built.schema] == [
        (f.name, f.dataType) for f in ORDER_ITEMS
    ]
    report = quality.validate(built).first()
    assert report.grain_is_valid
    assert report.row_count == 6000
    quality.require_valid(built, ["grain_is_valid", "invalid_prices"])


def test_a_bad_grain_is_reported_and_can_stop_the_job(built):
    doubled = built.unionByName(built)
    assert not quality.validate(doubled).first().grain_is_valid
    with pytest.raises(ValueError, match="grain_is_valid"):
        quality.require_valid(doubled)


def test_an_order_with_very_many_items_is_spread(spark, staged, built):
    """A third of all items in one order: same table, and its items in many partitions."""
    items = staged["order_items"]
    hot_order = items.first().order_id
    hot = items.withColumn("order_id", F.when(F.rand(1) < 0.4, F.lit(hot_order)).otherwise(F.col("order_id")))
    hot.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/hot_items")
    hot = spark.read.parquet(path)
    changed = {**staged, "order_items": hot}
    keys = skew.hot_keys(hot, "order_id", 100)
    assert hot_order in [r.order_id for r in keys.collect()]
    salted = skew.salt_rows(hot, keys, "order_id").filter(F.col("order_id") == hot_order)
    sizes = [r["count"] for r in salted.groupBy(skew.SALT).count().collect()]
    assert len(sizes) > 10 and max(sizes) < 300
    spread = model.build_order_items(changed, rows_per_salt=100)
    plain = model.build_order_items(changed)
    assert spread.count() == plain.count() == hot.join(staged["orders"], "order_id").count()
    assert spread.exceptAll(plain).count() == 0


def test_without_hot_orders_nothing_is_salted(spark, staged):
    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    assert skew.SALT not in plan(model.build_order_items(staged, rows_per_salt=10**6))
    assert skew.SALT in plan(model.build_order_items(staged, rows_per_salt=2))


def test_no_shuffle_carries_what_other_columns_give(spark, staged, built):
    """Days, flags and totals are computed above the exchange that gathers the months."""
    dealt = model.build_order_items(staged, dealt_by="purchase_month_start")
    dealt_rows = dealt._jdf.queryExecution().optimizedPlan().children().apply(0)
    assert dealt_rows.nodeName() == "RebalancePartitions"
    carried = dealt_rows.output().mkString(" ")
    for name in ("delivery_days", "is_late_delivery", "purchase_year", "item_total_value"):
        assert name not in carried and name in dealt.columns
    assert dealt.columns == built.columns
    assert dealt.exceptAll(built).count() == built.exceptAll(dealt).count() == 0


def test_orders_are_dealt_by_their_id_once(spark, staged, built):
    """Orders, payments, reviews and items: none of the four is dealt by order_id again."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = model.build_order_items(staged)
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(order_id") == 4
        assert table.exceptAll(built).count() == built.exceptAll(table).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_what_items_of_an_order_share_comes_first_in_the_shuffle(spark, staged):
    dealt = model.build_order_items(staged, dealt_by="purchase_month_start")
    rows = dealt._jdf.queryExecution().optimizedPlan().children().apply(0)
    names = re.sub(r"#\d+L?", "", rows.output().mkString(" ")).split()
    own = {"freight", "order_item_id", "price", "seller_id", "product_id", "product_category"}
    assert set(names[-6:]) == own and names[0] == "purchase_month_start"


def test_every_hot_order_is_split(spark, staged):
    """120 orders of 100 items each: all are found, spread and joined, none is left whole."""
    items = staged["order_items"].filter("order_item_id IS NOT NULL").limit(50)
    wide = items.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(239))))
    orders = [r.order_id for r in staged["orders"].select("order_id").distinct().limit(120).collect()]
    number = F.pmod(F.xxhash64("order_item_id", "n"), F.lit(120)).cast("int")
    hot = wide.withColumn("order_id", F.get(F.array(*[F.lit(o) for o in orders]), number)).drop("n")
    hot.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/many_hot_items")
    hot = spark.read.parquet(path)
    keys = skew.hot_keys(hot, "order_id", 20)
    assert keys.count() == 120
    salts = skew.salt_rows(hot, keys, "order_id").groupBy("order_id").agg(F.count_distinct(skew.SALT).alias("n"))
    assert salts.filter("n < 2").count() == 0
    changed = {**staged, "order_items": hot}
    spread, plain = (model.build_order_items(changed, n) for n in (20, 10**9))
    assert spread.count() == plain.count() == 12000
    assert spread.exceptAll(plain).count() == 0


def test_stored_table_reads_back_and_prunes_months(spark, built, tmp_path):
    path = str(tmp_path / "order_items")
    tables.write_order_items(built, path)
    stored = tables.read_order_items(spark, path)
    assert stored.schema == ORDER_ITEMS
    assert stored.exceptAll(built).count() == 0 and stored.count() == built.count()
    month = stored.filter(F.col("purchase_month_start") == F.lit("1998-03-01").cast("timestamp_ntz"))
    plan = month.select("item_price")._jdf.queryExecution().executedPlan().toString()
    partition_filters = plan[plan.index("PartitionFilters") :][:200]
    assert "purchase_month_start" in partition_filters
    assert "ReadSchema: struct<item_price:double>" in plan
    tables.write_order_items(built.limit(5), path)
    assert tables.read_order_items(spark, path).count() == 5


def test_missing_table(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="build_from_files"):
        tables.read_order_items(spark, str(tmp_path / "none"))


def test_missing_files_are_all_listed(spark, tmp_path):
    (tmp_path / "orders.csv").write_text("order_id\n")
    with pytest.raises(FileNotFoundError) as error:
        staging.required_files(spark, str(tmp_path))
    assert "customers.csv" in str(error.value) and "reviews.csv" in str(error.value)
    assert "orders.csv" not in str(error.value).replace("order_items.csv", "")


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text(
        'review_id,review_score,comment,order_id\nr1,5,"two\nlines, ""quoted""",o1\nr2,bad,,o2\n'
    )
    df = staging.read_csv_source(spark, "reviews", str(path), "null")
    assert sorted(map(tuple, df.collect())) == [("o1", 5), ("o2", None)]
    counts = staging.bad_value_counts(spark, "reviews", str(path))
    assert {r.column_name: r.bad_values for r in counts.collect()} == {
        "order_id": 0,
        "review_score": 1,
    }
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        staging.read_csv_source(spark, "reviews", str(path)).collect()
    split = staging.read_csv_source(spark, "reviews", str(path), "null", multiline=())
    assert split.count() == 3
    path.write_text("order_id\no1\n")
    with pytest.raises(ValueError, match="review_score"):
        staging.read_csv_source(spark, "reviews", str(path))


def test_build_from_files(spark, staged, built, tmp_path):
    for name, df in staged.items():
        df.write.option("header", True).csv(str(tmp_path / f"in/{name}.dat"))
    files = {name: f"{name}.dat" for name in staged}
    table = tables.build_from_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), files)
    assert table.count() == built.count()
    assert table.exceptAll(built).count() == 0
    assert tables.table_summary(table).first().column_count == 31
    assert tables.table_schema(table).count() == 31


def test_a_customer_with_very_many_orders_is_split(spark, staged, tmp_path):
    """Without broadcasts, the adaptive skew join splits the orders of a hot customer."""
    at_customer = F.when(F.rand(3) < 0.4, F.lit("1")).otherwise(F.col("customer_id"))
    folder = str(tmp_path / "orders")
    staged["orders"].withColumn("customer_id", at_customer).repartition(8).write.parquet(folder)
    changed = {**staged, "orders": spark.read.parquet(folder)}
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        # A split needs more than one upstream task; small data would be merged into one.
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df = model.build_order_items(changed)
        assert len(df.collect()) == 6000
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    customers = [line for line in plan.splitlines() if "SortMergeJoin" in line and "customer_id" in line]
    assert customers and all("skew=true" in line for line in customers)


def test_written_source_files_are_packed(spark, sf_dir):
    """The seven sources that are written to be staged are packed, and whole when they are read."""
    import __spark_entry__ as registered

    paths = staging.required_files(spark, registered._csv_folder(spark, sf_dir))
    files = [r.file for r in staging.source_files(spark, paths).collect() if ".csv/part-" in r.file]
    assert files and all(f.endswith(".csv.gz") for f in files)
    staged = staging.read_staging(spark, paths)
    for name, df in adapter.staging_from_star_schema(spark, sf_dir).items():
        assert staged[name].count() == df.count()
