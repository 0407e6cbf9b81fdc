import pytest

from marketlens.plans import investigate
from tests.fixtures import FEB, JAN, MAR, investigation_table


@pytest.fixture(scope="module")
def table(spark):
    return investigation_table(spark)


@pytest.fixture(scope="module")
def components(table):
    return investigate.monthly_revenue_components(table, 1)


def ask(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "question_id int, question string")


def test_components(components):
    february = components.collect()[1]
    assert (february.item_revenue, february.order_count, february.average_order_value) == (
        180.0,
        2,
        90.0,
    )
    assert (february.revenue_change_amount, february.revenue_change_percentage) == (-120.0, -40.0)
    assert february.order_count_change_percentage == -33.33
    assert february.average_order_value_change_percentage == -10.0
    assert february.previous_month_start == JAN


def test_forms_of_a_month(spark, components):
    questions = ask(
        spark,
        "Why did revenue drop in 2024-02?",
        "Why did revenue drop in February 2024?",
        "Why did revenue drop in february?",
        "Why did revenue drop?",
        "Why did revenue drop, maybe in march",
        "2024-01?",
        "June",
        "February 2023",
    )
    rows = investigate.resolve_target_months(questions, components).orderBy("question_id").collect()
    assert [r.target_month for r in rows] == [FEB, FEB, FEB, FEB, MAR, None, None, None]
    assert [r.month_error is None for r in rows] == [True] * 5 + [False] * 3


def test_one_text_and_a_column_agree_on_the_key(spark, components):
    texts = ["in 2024-13 or May 2031", "maybe 2024-05", " JUNE ", "may and april 1999", "x2024-01"]
    rows = investigate.resolve_target_months(ask(spark, *texts), components)
    found = {r.question: r.month_key for r in rows.collect()}
    assert found == {t: investigate.month_key_text(t) for t in texts}


def test_first_driver_of_a_decline_is_the_largest_loss(table):
    category = investigate.category_revenue_change(table, FEB, JAN).first()
    state = investigate.state_revenue_change(table, FEB, JAN).first()
    assert (category.product_category, category.change_amount) == ("electronics", -120.0)
    assert (state.customer_state, state.change_amount) == ("CA", -120.0)


def test_first_driver_of_a_rise_is_the_largest_gain(table):
    rows = investigate.category_revenue_change(table, "2024-03-01", "2024-02-01").collect()
    assert [r.product_category for r in rows] == ["electronics", "furniture"]
    assert sum(r.contribution_to_total_change_percentage for r in rows) == 100.0


def test_new_and_vanished_values(spark, table):
    more = spark.createDataFrame(
        [("n", 1, FEB, "toys", "CA", 10.0), ("o", 1, JAN, "books", "CA", 20.0)], table.schema
    )
    rows = investigate.category_revenue_change(table.unionByName(more), FEB, JAN).collect()
    found = {r.product_category: tuple(r)[1:5] for r in rows}
    assert found["toys"] == (0.0, 10.0, 10.0, None)
    assert found["books"] == (20.0, 0.0, -20.0, -100.0)


def test_all_months_at_once_agree_with_single_ones(table, components):
    months = investigate.comparable_months(components)
    together = investigate.revenue_changes(table, months, ["product_category"]).collect()
    for current, previous in ((FEB, JAN), (MAR, FEB)):
        single = investigate.category_revenue_change(table, current, previous).collect()
        of_month = sorted(
            (r for r in together if r.target_month == current), key=lambda r: r.change_rank
        )
        assert [tuple(r) for r in single] == [tuple(r)[2:-1] for r in of_month]


def test_investigation_lists_the_drivers(spark, table):
    rows = investigate.investigate(
        table, ask(spark, "Why did revenue drop in 2024-02?", "and in June?"), 1, 1
    ).collect()
    found = {(r.question_id, r.evidence_scope): r for r in rows}
    assert found[0, "category_change"].dimension_value == "electronics"
    assert found[0, "state_change"].dimension_value == "CA"
    assert found[1, None].month_error


def test_bad_arguments(table):
    with pytest.raises(ValueError, match="Unsupported"):
        investigate.revenue_change(table, "seller_id", FEB, JAN)
    with pytest.raises(ValueError, match="greater than zero"):
        investigate.monthly_revenue_components(table, 0)
    with pytest.raises(ValueError, match="greater than zero"):
        investigate.investigate(table, None, 1, 0)
    with pytest.raises(ValueError, match="Missing required columns"):
        investigate.month_keys(table)
