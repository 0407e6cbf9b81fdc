import glob
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marketlens.operators import quality
from marketlens.operators.reduce import at_order_grain, orders_of
from marketlens.plans import metrics
from marketlens.schema import ORDER_ITEMS
from marketlens import session
from marketlens.session import stored
from marketlens.sources import tables
from tests.fixtures import metrics_table


def full_table(spark, **columns):
    base = metrics_table(spark)
    missing = [f for f in ORDER_ITEMS.fields if f.name not in base.columns]
    for f in missing:
        base = base.withColumn(f.name, F.lit(None).cast(f.dataType))
    for name, value in columns.items():
        base = base.withColumn(name, value)
    return base.select(*[F.col(f.name).cast(f.dataType) for f in ORDER_ITEMS.fields])


def test_a_projection_of_items_is_not_taken_for_orders(spark):
    items = full_table(spark)
    projected = items.drop("order_item_id").withColumn("revenue", F.lit(1.0)).withColumn("freight", F.lit(1.0))
    assert not at_order_grain(projected)
    assert metrics.business_kpis(projected).collect() == metrics.business_kpis(items).collect()


def test_orders_are_known_as_such_also_when_stored_or_selected(spark, tmp_path):
    items = full_table(spark)
    orders = orders_of(items)
    tables.write_orders(items, str(tmp_path / "orders"))
    for table in (orders, stored(orders, "orders"), spark.read.parquet(str(tmp_path / "orders")), orders.filter("revenue > 0")):
        assert at_order_grain(table)
    assert at_order_grain(orders.select("order_id", "revenue"))
    assert metrics.business_kpis(orders).collect() == metrics.business_kpis(items).collect()


def test_a_write_reports_what_a_scan_would(spark, tmp_path):
    bad = full_table(spark, item_price=F.when(F.col("order_id") == "o1", -1.0).otherwise(F.col("item_price")))
    doubled = bad.unionByName(bad.limit(1))
    for i, df in enumerate((bad, doubled, bad.limit(0))):
        path = str(tmp_path / f"t{i}")
        report = tables.write_validated(df, path)
        scanned = quality.validate(tables.read_order_items(spark, path))
        assert [(f.name, f.dataType) for f in report.schema] == [(f.name, f.dataType) for f in scanned.schema]
        assert report.collect() == scanned.collect()


def test_rows_that_were_observed_twice_are_counted_by_a_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    df = full_table(spark)
    tables.write_order_items(df, path)
    table = tables.read_order_items(spark, path)
    once = quality.validate(table)
    observed = {**once.first().asDict(), "row_count": 10_000, "item_revenue": 1e9}
    assert quality.report_of_write(table, observed).collect() == once.collect()


def test_a_write_that_fails_has_no_report(spark, tmp_path):
    broken = full_table(spark, delivery_days=F.raise_error(F.lit("no days")).cast("long"))
    with pytest.raises(PySparkException):
        tables.write_validated(broken, str(tmp_path / "t"))


def _shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for folder in folders for f in glob.glob(f"{folder}/*/shuffle_*.data")}


def test_a_stored_table_leaves_no_shuffle_on_the_disk(spark, tmp_path):
    df = spark.range(100_000).selectExpr("id % 5000 AS order_id", "id").groupBy("order_id").agg(F.max("id").alias("last"))
    writes = (
        lambda: stored(df, "lean"),
        lambda: stored(df.withColumn("part", F.col("order_id") % 3), "lean", "part"),
        lambda: tables.write_order_items(full_table(spark).repartition(3, "order_id"), str(tmp_path / "items")),
        lambda: tables.write_orders(full_table(spark), str(tmp_path / "orders")),
    )
    for write in writes:
        before = _shuffle_files(spark)
        write()
        until = time.time() + 10
        while (left := _shuffle_files(spark) - before) and time.time() < until:
            time.sleep(0.2)
        assert not left
    # What is read again later isn't affected.
    assert df.count() == stored(df, "lean").count() == 5000


def test_settings_of_a_write_are_put_back_also_when_it_fails(spark):
    before = {key: spark.conf.get(key) for key in session.LEAN_WRITES}
    with pytest.raises(PySparkException):
        stored(spark.range(3).select(F.raise_error(F.lit("no rows")).cast("long").alias("id")), "failed")
    assert {key: spark.conf.get(key) for key in session.LEAN_WRITES} == before


def test_folders_are_filled_by_the_tasks_that_counted(spark):
    """More folders than are kept open: the rows of the others are sorted, none is lost."""
    df = spark.range(3000).select((F.col("id") % (session.OPEN_FOLDERS + 50)).cast("string").alias("part"), "id")
    table = stored(df.repartition(2), "folders", "part")
    assert sorted(r.id for r in table.collect()) == list(range(3000))
    assert table.select("part").distinct().count() == session.OPEN_FOLDERS + 50
