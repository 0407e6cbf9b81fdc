import re

import pytest
from pyspark.sql import functions as F

from marketlens.operators import model
from marketlens.schema import SOURCES
from marketlens.sources import adapter, layout


@pytest.fixture(scope="module")
def staged(spark, sf_dir):
    return adapter.staging_from_star_schema(spark, sf_dir)


@pytest.fixture
def without_broadcasts(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return re.findall(r"(?<!Broadcast)Exchange (\w+)", plan_of(df))


def same_rows(left, right):
    assert left.columns == right.columns
    assert left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def test_no_exchange_under_the_order_joins(spark, staged, tmp_path, without_broadcasts):
    layout.store_by_order(staged, str(tmp_path), buckets=3, rows_per_salt=10**9)
    built = layout.build_from_layout(spark, str(tmp_path))
    assert shuffles(built) == []
    assert plan_of(built).count("SortMergeJoin") == 3
    assert len(shuffles(model.build_order_items(staged))) > 4
    same_rows(built, model.build_order_items(staged))


def test_hot_orders_stay_outside_the_buckets(spark, staged, tmp_path):
    changed = dict(staged)
    # A third of all items is one order's, and some items and orders have no id
    items, key = staged["order_items"], F.col("order_id")
    first = F.lit(staged["orders"].agg(F.min("order_id")).first()[0])
    number = F.col("order_item_id")
    changed["order_items"] = items.withColumn(
        "order_id", F.when(number % 3 == 0, first).when(number % 101 != 0, key)
    )
    changed["orders"] = staged["orders"].withColumn(
        "order_id", F.when(F.xxhash64("order_id") % 29 != 0, key)
    ).unionByName(staged["orders"].filter(key == first).filter(F.xxhash64("order_id") % 29 == 0))
    layout.store_by_order(changed, str(tmp_path), buckets=4)
    tables, n_hot = layout.open_by_order(spark, str(tmp_path))
    assert n_hot >= 1
    assert tables["order_items"].filter(key == first).isEmpty()
    spread = tables["hot_order_items"].groupBy("order_id").agg(F.countDistinct("_salt").alias("n"))
    assert spread.filter(key == first).first().n > 1
    same_rows(layout.build_from_layout(spark, str(tmp_path)), model.build_order_items(changed))


def test_a_layout_opens_in_another_session(spark, staged, tmp_path, without_broadcasts):
    folder = str(tmp_path)
    layout.store_by_order(staged, folder, buckets=3)
    for table in spark.catalog.listTables(pattern="by_order_*"):
        # What a new catalog knows: nothing. The files stay, as the tables are external.
        spark.sql(f"DROP TABLE {table.name}")
    built = layout.build_from_layout(spark, folder)
    assert plan_of(built).count("Bucketed: true") >= 4
    same_rows(built, model.build_order_items(staged))


def test_a_second_store_replaces_the_first(spark, staged, tmp_path):
    folder = str(tmp_path)
    layout.store_by_order(staged, folder, buckets=5)
    few = {**staged, "order_items": staged["order_items"].filter("order_item_id % 2 = 0")}
    layout.store_by_order(few, folder, buckets=2)
    same_rows(layout.build_from_layout(spark, folder), model.build_order_items(few))


def test_an_unfinished_or_missing_layout_says_so(spark, staged, tmp_path):
    with pytest.raises(FileNotFoundError):
        layout.build_from_layout(spark, str(tmp_path / "none"))
    broken = {**staged, "payments": staged["payments"].withColumn("payment_value", F.raise_error(F.lit("x")).cast("double"))}
    with pytest.raises(Exception, match="x"):
        layout.store_by_order(broken, str(tmp_path / "half"), buckets=2)
    with pytest.raises(FileNotFoundError):
        layout.build_from_layout(spark, str(tmp_path / "half"))


def test_empty_tables(spark, tmp_path):
    empty = {name: spark.createDataFrame([], schema) for name, schema in SOURCES.items()}
    layout.store_by_order(empty, str(tmp_path), buckets=2)
    assert layout.build_from_layout(spark, str(tmp_path)).isEmpty()


def test_a_long_list_of_hot_orders_is_not_broadcast(spark, staged, tmp_path, without_broadcasts, monkeypatch):
    from marketlens.operators import skew

    short = str(tmp_path / "short")
    layout.store_by_order(staged, short, buckets=3, rows_per_salt=1)
    table = layout.build_from_layout(spark, short)
    assert "BroadcastExchange" in plan_of(table)
    expected = sorted(map(str, table.collect()))
    monkeypatch.setattr(skew, "BROADCAST_KEYS", 0)
    long = str(tmp_path / "long")
    layout.store_by_order(staged, long, buckets=3, rows_per_salt=1)
    table = layout.build_from_layout(spark, long)
    assert "BroadcastExchange" not in plan_of(table)
    assert sorted(map(str, table.collect())) == expected and expected
