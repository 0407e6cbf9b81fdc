import pytest
from pyspark.sql import functions as F

from marketlens.plans import metrics
from tests.fixtures import JAN, FEB, metrics_table


@pytest.fixture(scope="module")
def table(spark):
    return metrics_table(spark)


def test_single_metrics(table):
    assert metrics.item_revenue(table).collect() == [(300.0,)]
    assert metrics.freight_value(table).collect() == [(28.0,)]
    assert metrics.order_count(table).collect() == [(3,)]
    assert metrics.late_delivery_rate(table).collect() == [(33.33,)]
    assert metrics.average_review_score(table).collect() == [(3.0,)]


def test_orders_with_several_items_weigh_once(table):
    assert metrics.average_order_value(table).collect() == [(100.0,)]


def test_kpis_in_one_row(table):
    row = metrics.business_kpis(table).first().asDict()
    assert row == {
        "item_revenue": 300.0,
        "freight_value": 28.0,
        "order_count": 3,
        "average_order_value": 100.0,
        "late_delivery_rate_percentage": 33.33,
        "average_review_score": 3.0,
    }


def test_kpis_of_an_empty_table_are_zero(table):
    assert tuple(metrics.business_kpis(table.limit(0)).first()) == (0.0, 0.0, 0, 0.0, 0.0, 0.0)


def test_duplicated_items_do_not_change_order_level_metrics(table):
    doubled = table.unionByName(table)
    once, twice = (metrics.business_kpis(t).first() for t in (table, doubled))
    for name in ("order_count", "late_delivery_rate_percentage", "average_review_score"):
        assert once[name] == twice[name]


def test_trend_starts_without_growth(table):
    rows = metrics.monthly_revenue_trend(table).collect()
    assert [tuple(r) for r in rows] == [(JAN, 150.0, 2, None), (FEB, 150.0, 1, 0.0)]


def test_kpis_read_the_table_once_and_only_what_they_need(spark, table, tmp_path):
    path = str(tmp_path / "t")
    table.write.parquet(path)
    plan = metrics.business_kpis(spark.read.parquet(path))._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert text.count("FileScan") == 1
    assert "purchase_month_start" not in text


def test_an_order_grain_table_gives_the_same(spark):
    from marketlens.operators.reduce import orders_of
    from marketlens.plans import delivery
    from tests.fixtures import delivery_table

    items = delivery_table(spark).withColumns({"item_price": F.lit(2.5), "freight_value": F.lit(1.0), "order_item_id": F.lit(1)})
    orders = orders_of(items)
    for function in (
        metrics.average_order_value, metrics.late_delivery_rate, metrics.average_review_score,
        metrics.business_kpis, delivery.late_and_on_time_orders, delivery.delivery_review_relationship,
        lambda df: delivery.delivery_by_state(df, 1),
    ):
        found = function(orders)
        assert found.collect() == function(items).collect()
    plan = metrics.business_kpis(spark.createDataFrame(orders.collect(), orders.schema))
    assert "hashpartitioning(order_id" not in plan._jdf.queryExecution().executedPlan().toString()
