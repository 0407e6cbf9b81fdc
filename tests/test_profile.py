import decimal
import math
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketlens.operators import median, profile, semantic
from marketlens.schema import ORDER_ITEMS
from tests.fixtures import delivery_table, metrics_table

NUMBERS = st.floats(allow_nan=False, allow_infinity=False, width=32).map(lambda x: x + 0.0)


@given(st.lists(st.tuples(st.sampled_from("ab"), NUMBERS), min_size=1, max_size=60))
@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
def test_median_is_exact(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double")
    found = median.exact_median(median.value_counts(df, ["k"], "v"), ["k"]).collect()
    expected = {
        key: statistics.median([v for k, v in rows if k == key]) for key in {k for k, _ in rows}
    }
    assert {r.k for r in found} == set(expected)
    for r in found:
        assert math.isclose(r["median"], expected[r.k], rel_tol=1e-12, abs_tol=1e-300)


HARD = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, 0.9999999999999999,
        1.0000000000000002, -1.0, 2.0**52, 2.0**52 + 1, 1.7976931348623157e308, -1.7976931348623157e308,
        8.0, 7.999999999999999, 1e-300, 3.0, float("inf"), float("-inf"), 0.1, 1e15 + 0.5]


def test_codes_order_numbers(spark):
    """All neighbours of powers of two, subnormals, infinities and a NaN keep their order."""
    numbers = set(HARD) | {x * (2.0**k) for k in range(-1070, 1020, 7) for x in (1.0, 1 + 2**-52, 2 - 2**-52)}
    df = spark.createDataFrame([(x,) for x in [*numbers, math.nan]], "v double")
    code = median.sort_code(F.col("v"), df.schema["v"].dataType)
    rows = [(r.v, r.code) for r in df.select("v", code.alias("code")).collect()]
    (largest,) = [c for v, c in rows if math.isnan(v)]
    rows = sorted((v, c) for v, c in rows if not math.isnan(v))
    for (a, x), (b, y) in zip(rows, rows[1:], strict=False):
        assert (x < y) == (a < b), (a, b, x, y)
    assert largest > rows[-1][1]


@pytest.mark.parametrize("kind, make", [
    ("bigint", lambda i: 10**12 + i * 3), ("bigint", lambda i: 2**62 + i), ("double", lambda i: i * 1e-9),
    ("decimal(18,4)", lambda i: decimal.Decimal(i) / 10000), ("int", lambda i: -i),
])
def test_dense_numbers_do_not_share_a_counter(spark, kind, make):
    values = [make(i * i % 5003) for i in range(3001)]
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    (row,) = profile.numeric_statistics(df).collect()
    assert row["median"] == float(sorted(values)[1500])
    codes = median.value_counts(df, [], "v").select("code").distinct().count()
    assert codes == len(set(values))


def test_not_a_number_is_the_largest(spark):
    df = spark.createDataFrame([(x, 1) for x in (1.0, 2.0, math.nan, math.nan, math.inf)], "v double, n int")
    rows = {r.column_name: r for r in profile.numeric_statistics(df).collect()}
    assert rows["v"]["median"] == math.inf and math.isnan(rows["v"].maximum)
    shown = {r.column_name: r for r in profile.profile_table(df).collect()}
    assert shown["v"].unique_count == 4


def test_profile(spark):
    df = spark.createDataFrame(
        [(1, "x", True, 0.0), (2, "x", None, -0.0), (4, "y", False, None), (9, None, True, 1.5)],
        "n int, t string, b boolean, d double",
    )
    rows = {r.column_name: r for r in profile.profile_table(df).collect()}
    assert [rows[c].unique_count for c in "ntbd"] == [4, 2, 2, 2]
    assert [rows[c].null_count for c in "ntbd"] == [0, 1, 1, 1]
    assert rows["t"].null_percentage == 25.0 and rows["t"].cardinality_ratio == 0.5
    assert [tuple(v) for v in rows["t"].most_common_values] == [("x", 2), ("y", 1)]
    assert rows["b"].sample_values == ["false", "true"]
    assert (rows["n"].statistics["mean"], rows["n"].statistics["median"]) == (4.0, 3.0)
    assert rows["t"].statistics is None and rows["n"].most_common_values is None


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "n int, t string")
    rows = profile.profile_table(df).collect()
    assert [(r.null_percentage, r.cardinality_ratio, r.unique_count) for r in rows] == [
        (0.0, 0.0, 0)
    ] * 2


def test_registry_covers_the_table():
    assert list(semantic.REGISTRY) == ORDER_ITEMS.fieldNames()


def test_registered_meaning():
    price, paid = semantic.REGISTRY["item_price"], semantic.REGISTRY["total_payment_value"]
    assert (price["semantic_role"], price["metric_grain"]) == ("measure", "order_item")
    assert (price["default_aggregation"], price["is_additive"]) == ("sum", True)
    assert (paid["metric_grain"], paid["is_additive"]) == ("order", False)
    assert paid["default_aggregation"] == "order_level_sum" and paid["warning"]
    primary = [n for n, e in semantic.REGISTRY.items() if e["is_primary_time_dimension"]]
    assert primary == ["purchase_timestamp"]


def test_metadata_is_saved(spark, tmp_path):
    df = metrics_table(spark).withColumn("extra_flag", F.lit(True))
    metadata = semantic.build_semantic_metadata(df)
    rows = {r.column_name: r for r in metadata.collect()}
    assert rows["item_price"].inference_source == "business_registry"
    assert rows["extra_flag"].inference_source == "heuristic"
    assert rows["extra_flag"].semantic_role == "boolean_measure"
    assert semantic.aggregation_warnings(metadata).count() == 2
    semantic.save_semantic_metadata(metadata, str(tmp_path / "deep" / "metadata"))
    assert spark.read.json(str(tmp_path / "deep" / "metadata")).count() == 8


def test_governed_aggregation(spark):
    table = delivery_table(spark)

    def value(*args, **kwargs):
        rows = semantic.aggregate_metric(table, *args, **kwargs).collect()
        return rows[0].value if len(rows) == 1 else {r[0]: r.value for r in rows}

    assert value("is_late_delivery") == 50.0
    assert value("is_late_delivery", "count_true") == 3
    # Each order once: (5 + 10 + 15 + 7 + 20 + 4) / 6
    assert value("delivery_days") == 10.17
    assert value("delivery_days", "median") == 8.5
    assert value("delivery_days", "maximum", by=["customer_state"]) == {"CA": 10, "TX": 15, "NY": 20}
    assert value("seller_id") == 3
    extra = table.withColumns({"gift": F.col("delivery_days") > 9, "weight": F.col("delivery_days") * 1.5})
    rows = semantic.aggregate_metric(extra.drop("order_id"), "gift").collect()
    assert rows[0].value == pytest.approx(100 * extra.filter("gift").count() / extra.filter("gift IS NOT NULL").count(), abs=0.01)
    middle = semantic.aggregate_metric(extra, "weight", "median", by=["customer_state"]).collect()
    assert {r.customer_state for r in middle} == {"CA", "TX", "NY"}
    with pytest.raises(ValueError, match="Cannot group"):
        semantic.aggregate_metric(extra, "weight", by=["gift"])
    with pytest.raises(ValueError):
        semantic.aggregate_metric(extra, "weight", "sum")
    for bad in [("delivery_days", "sum"), ("average_review_score", "median"), ("nothing", None)]:
        with pytest.raises(ValueError):
            value(*bad)
    with pytest.raises(ValueError):
        value("customer_state", "group_by")
    with pytest.raises(ValueError):
        value("delivery_days", by=["item_price"])


def test_numbers_and_times_are_not_counted_as_texts(spark):
    """Only columns of texts have texts as keys; the counts of a column of each type are right."""
    df = spark.sql(
        "SELECT id % 3 AS whole, (id % 4) / 2.0D AS share, CAST(id % 5 AS decimal(9,2)) AS exact, id % 2 = 0 AS flag, "
        "CAST(id % 6 AS string) AS text, CAST(date_add(DATE'2001-01-01', CAST(id % 7 AS int)) AS timestamp_ntz) AS at, "
        "CAST(id % 3 AS smallint) AS small FROM range(840)"
    )
    counts = profile.value_counts(df)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_count(1)") == 5
    found = {}
    for r in counts.collect():
        found.setdefault(r.column_name, {})[r.value] = r.n
    assert found["whole"] == found["small"] == {"0": 280, "1": 280, "2": 280}
    assert found["share"] == {"0.0": 210, "0.5": 210, "1.0": 210, "1.5": 210}
    assert found["exact"] == {f"{i}.00": 168 for i in range(5)}
    assert found["flag"] == {"true": 420, "false": 420}
    assert found["at"] == {f"2001-01-0{i + 1} 00:00:00": 120 for i in range(7)}
