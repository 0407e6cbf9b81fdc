import random

import numpy as np
import pyarrow as pa
import pytest

from marketlens.operators import profile, summaries


@pytest.mark.parametrize("capacity", [1, 3, 10])
def test_bounds_of_a_reduced_summary(capacity):
    chance = random.Random(capacity)
    for _ in range(50):
        counts = np.array([chance.randrange(1, 9) for _ in range(chance.randrange(1, 20))])
        values = pa.array([str(i) for i in range(len(counts))])
        kept, least, error = summaries.reduced(values, counts, capacity)
        assert len(kept) == len(least) <= capacity or error == 0
        bounds = dict(zip(kept.to_pylist(), least))
        for i, n in enumerate(counts):
            low = bounds.get(str(i), 0)
            assert low <= n <= low + error


def table(spark, n=900):
    chance = random.Random(3)
    rows = [
        (
            f"id{i}", chance.choice("aabbbcdé"), None if chance.random() < 0.5 else f"v{int(chance.paretovariate(1))}",
            chance.random() < 0.3, chance.choice([0.0, -0.0, 1.5, None]), None,
        )
        for i in range(n)
    ]
    schema = "id string, few string, `many ``odd` string, flag boolean, number double, unknown string"
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.mark.parametrize("capacity", [2, 7, 64])
def test_frequent_values_are_those_of_the_whole_count(spark, capacity):
    df = table(spark)
    found = summaries.frequent_values(df, 5, capacity).collect()
    assert sorted(found) == sorted(profile.most_common_values(df, 5).collect())


def test_smallest_values_are_those_of_the_whole_count(spark):
    df = table(spark)
    assert sorted(summaries.smallest_values(df).collect()) == sorted(profile.sample_values(df).collect())
    shuffled = summaries._texts(df, df.columns).mapInArrow(
        summaries._smallest(df.columns, 5), "column_name string, value string"
    )
    assert shuffled.count() <= 5 * len(df.columns) * df.rdd.getNumPartitions()


def test_summaries_of_an_empty_table(spark):
    df = table(spark).limit(0)
    assert summaries.smallest_values(df).count() == summaries.frequent_values(df).count() == 0
