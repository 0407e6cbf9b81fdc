import pytest

from marketlens.plans import delivery
from tests.fixtures import delivery_table


@pytest.fixture(scope="module")
def table(spark):
    return delivery_table(spark)


def by_key(df):
    return {r[0]: r.asDict() for r in df.collect()}


def test_states(table):
    states = by_key(delivery.delivery_by_state(table, 1))
    assert states["CA"] == {
        "customer_state": "CA",
        "order_count": 2,
        "reviewed_order_count": 2,
        "review_coverage_percentage": 100.0,
        "average_delivery_days": 7.5,
        "median_delivery_days": 7.5,
        "late_delivery_rate_percentage": 50.0,
        "average_delay_days": -0.5,
        "average_late_days_among_late_orders": 2.0,
        "average_review_score": 3.5,
    }
    assert states["NY"]["reviewed_order_count"] == 1
    assert states["NY"]["review_coverage_percentage"] == 50.0
    assert states["NY"]["average_review_score"] == 5.0


def test_an_order_counts_once_per_category(table):
    electronics = by_key(delivery.delivery_by_category(table, 1))["electronics"]
    assert electronics["order_count"] == 3
    assert electronics["late_delivery_rate_percentage"] == 33.33
    assert electronics["average_review_score"] == 3.67


def test_late_against_on_time(table):
    groups = by_key(delivery.late_and_on_time_orders(table))
    assert list(groups) == ["late", "on_time"]
    late, on_time = groups["late"], groups["on_time"]
    assert (late["order_count"], late["reviewed_order_count"]) == (3, 2)
    assert (late["review_coverage_percentage"], late["average_review_score"]) == (66.67, 1.5)
    assert (on_time["order_count"], on_time["review_coverage_percentage"]) == (3, 100.0)
    assert on_time["average_review_score"] == 4.67


def test_worst_sellers(table):
    sellers = delivery.worst_delivery_sellers(table, 2, 2).collect()
    assert [(r.seller_id, r.late_delivery_rate_percentage) for r in sellers] == [
        ("seller_b", 100.0),
        ("seller_c", 50.0),
    ]
    assert sellers[0].average_late_days_among_late_orders == 4.0


def test_bands_in_order(table):
    bands = delivery.delivery_review_relationship(table).collect()
    assert [r.delivery_delay_band for r in bands] == [
        "more_than_7_days_early",
        "1_to_7_days_early",
        "on_estimated_date",
        "1_to_3_days_late",
        "4_to_7_days_late",
        "more_than_7_days_late",
    ]
    assert (bands[-1].reviewed_order_count, bands[-1].average_review_score) == (0, None)


@pytest.mark.parametrize(
    "call",
    [
        lambda t: delivery.delivery_by_state(t, 0),
        lambda t: delivery.delivery_by_category(t, -5),
        lambda t: delivery.worst_delivery_sellers(t, 0),
        lambda t: delivery.worst_delivery_sellers(t, 1, 0),
    ],
)
def test_bad_arguments(table, call):
    with pytest.raises(ValueError, match="greater than zero"):
        call(table)
