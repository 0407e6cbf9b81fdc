import math

import pytest
from pyspark.sql import functions as F

from marketlens.operators import sketches

ROWS = 20_000


@pytest.fixture(scope="module")
def table(spark):
    key = F.col("id")
    return spark.range(ROWS).select(
        (key % 7).alias("month"),
        (key + 10**9).alias("dense"),
        F.pow(F.lit(1.5), key % 60).alias("tail"),
        F.when(key % 3 == 0, float("nan")).otherwise(F.hash(key).cast("double")).alias("gaps"),
        F.when(key % 5 > 0, float("nan")).otherwise(1.0).alias("mostly_none"),
        (key % 11).cast("string").alias("few"),
        F.lit(None).cast("double").alias("unknown"),
    ).repartition(4)


def rank_error(values, estimate):
    below, upto = sum(v < estimate for v in values), sum(v <= estimate for v in values)
    return max(0, below - len(values) / 2, len(values) / 2 - upto) / len(values)


def test_errors_are_as_stated(table):
    found = {r.column_name: r for r in sketches.merged_profile(sketches.month_sketches(table, "month")).collect()}
    for name in ("dense", "tail", "gaps", "few"):
        values = [r[0] for r in table.select(name).collect()]
        distinct = len({str(v) for v in values})
        assert abs(found[name].distinct_estimate - distinct) <= max(1, 4 * sketches.DISTINCT_ERROR * distinct)
        if name != "few":
            values = [math.inf if math.isnan(v) else v for v in values]
            assert rank_error(values, found[name].median_estimate) <= 2 * sketches.RANK_ERROR
    assert math.isnan(found["mostly_none"].median_estimate)
    assert found["few"].median_estimate is None
    assert tuple(found["unknown"])[1:] == (0, 0, None)


def test_a_new_month_is_merged_not_recounted(spark, table):
    old = sketches.month_sketches(table.filter("month < 6"), "month")
    newest = sketches.month_sketches(table.filter("month = 6"), "month")
    found = {r.column_name: r for r in sketches.merged_profile(sketches.updated(old, newest)).collect()}
    assert found["dense"].known_values == ROWS
    assert abs(found["dense"].distinct_estimate - ROWS) <= 4 * sketches.DISTINCT_ERROR * ROWS
    # A month that comes again takes the place of what was kept for it.
    again = sketches.merged_profile(sketches.updated(sketches.updated(old, newest), newest)).collect()
    assert {r.column_name: r.known_values for r in again}["dense"] == ROWS


def test_an_empty_table(table):
    assert sketches.merged_profile(sketches.month_sketches(table.limit(0), "month")).count() == 0
