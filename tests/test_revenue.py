import pytest

from marketlens.plans import revenue
from tests.fixtures import FEB, JAN, MAR, revenue_table


@pytest.fixture(scope="module")
def table(spark):
    return revenue_table(spark)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_categories_and_states(table):
    assert rows(revenue.revenue_by_category(table)) == [
        ("electronics", 350.0, 3, 43.75),
        ("furniture", 300.0, 1, 37.5),
        ("accessories", 150.0, 2, 18.75),
    ]
    assert [r[:2] for r in rows(revenue.revenue_by_state(table))] == [
        ("CA", 450.0),
        ("TX", 200.0),
        ("NY", 150.0),
    ]


def test_top_and_bottom(table):
    assert [r[0] for r in rows(revenue.top_revenue_categories(table, 2))] == [
        "electronics",
        "furniture",
    ]
    assert [r[0] for r in rows(revenue.bottom_revenue_categories(table, 2))] == [
        "accessories",
        "furniture",
    ]


def test_bottom_shares_leave_out_categories_without_revenue(spark, table):
    free = spark.createDataFrame(
        [("order_9", 1, JAN, "gifts", "CA", 0.0)], table.schema
    )
    found = rows(revenue.bottom_revenue_categories(table.unionByName(free), 5))
    assert [r[0] for r in found] == ["accessories", "furniture", "electronics"]
    assert sum(r[3] for r in found) == 100.0


def test_months_below_the_threshold_are_left_out(table):
    assert rows(revenue.complete_monthly_revenue(table, 2)) == [
        (JAN, 300.0, 2, None),
        (FEB, 400.0, 2, 33.33),
    ]


def test_largest_changes_by_size(table):
    found = rows(revenue.largest_monthly_revenue_changes(table, 1, 5))
    assert [(r[0], r[3]) for r in found] == [(MAR, -75.0), (FEB, 33.33)]


def test_only_known_dimensions(table):
    with pytest.raises(ValueError, match="Unsupported"):
        revenue.segment_revenue(table, "order_id")


@pytest.mark.parametrize(
    "call",
    [
        lambda t: revenue.revenue_by_category(t, 0),
        lambda t: revenue.revenue_by_state(t, -1),
        lambda t: revenue.bottom_revenue_categories(t, 0),
        lambda t: revenue.complete_monthly_revenue(t, 0),
        lambda t: revenue.largest_monthly_revenue_changes(t, 1, 0),
    ],
)
def test_bad_arguments(table, call):
    with pytest.raises(ValueError, match="greater than zero"):
        call(table)
