"""Profiles that follow the data: sketches per month, merged instead of counting all months again.

Opt-in. The exact distinct counts and medians of `profile` stay the default; these are estimates
with a stated error, and a new month costs a scan of that month only.
"""

from functools import reduce

from pyspark.sql import functions as F

from marketlens.operators import profile

#: Logarithm of the number of registers of a distinct-count sketch: a standard error of 1.04 / 64.
DISTINCT_LOG = 12
DISTINCT_ERROR = 1.04 / 2 ** (DISTINCT_LOG / 2)
#: Size of a quantile sketch, and the error of a rank, as a share of the rows, that 99 % of them keep.
QUANTILE_SIZE = 400
RANK_ERROR = 0.0083


def month_sketches(df, month="purchase_month_start"):
    """Rows (month, column_name, known, not_numbers, distinct_sketch, quantile_sketch).

    One scan and one aggregate; a sketch has the same size however many rows it stands for. The
    quantile sketch is NULL for columns that aren't numeric.
    """
    numeric = set(profile._columns(df, profile.NUMERIC))
    fields = [f for f in df.schema.fields if f.name != month]
    aggregates = []
    for i, f in enumerate(fields):
        c = profile._quoted(f.name)
        is_float = f.dataType.simpleString() in ("double", "float")
        # Adding zero makes the two double zeros one value, as in the exact profile.
        text = (c + F.lit(0.0) if is_float else c).cast("string")
        number = c.cast("double")
        # A sketch takes no NaN; infinity has its place among the ranks, and NaNs are counted.
        ranked = F.when(F.isnan(number), float("inf")).otherwise(number) if is_float else number
        aggregates += [
            F.count(c).alias(f"known_{i}"),
            (F.count_if(F.isnan(number)) if is_float else F.lit(0).cast("long")).alias(f"nan_{i}"),
            F.hll_sketch_agg(text, DISTINCT_LOG).alias(f"distinct_{i}"),
        ]
        if f.name in numeric:
            aggregates.append(F.kll_sketch_agg_double(ranked, QUANTILE_SIZE).alias(f"quantile_{i}"))
    wide = df.groupBy(F.col(month).alias("month")).agg(*aggregates)
    rows = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.col(f"known_{i}").alias("known"),
            F.col(f"nan_{i}").alias("not_numbers"),
            F.col(f"distinct_{i}").alias("distinct_sketch"),
            (F.col(f"quantile_{i}") if f.name in numeric else F.lit(None).cast("binary")).alias("quantile_sketch"),
        )
        for i, f in enumerate(fields)
    ]
    return wide.select("month", F.inline(F.array(*rows)))


def updated(sketches, newest):
    """The sketches with those of some months replaced, or added, by `newest`."""
    months = newest.select(F.col("month").alias("_month")).distinct()
    kept = sketches.join(F.broadcast(months), F.col("month").eqNullSafe(F.col("_month")), "left_anti")
    return kept.unionByName(newest)


def merged_profile(sketches):
    """Per column, of all months: known values, estimated distinct values and estimated median.

    The distinct count is off by DISTINCT_ERROR of itself (one standard deviation), the median's
    rank by RANK_ERROR of the known values. A NaN counts as the largest number, as in the exact
    median; the median is then NaN if more than half of the values are.
    """
    merged = sketches.groupBy("column_name").agg(
        F.sum("known").alias("known_values"),
        F.sum("not_numbers").alias("_nan"),
        F.hll_union_agg("distinct_sketch").alias("_distinct"),
        F.kll_merge_agg_double("quantile_sketch").alias("_quantile"),
        # What is merged of columns that aren't numeric, or have no values, is no sketch.
        F.count_if(F.col("quantile_sketch").isNotNull() & (F.col("known") > 0)).alias("_sketches"),
    )
    median = F.when(F.col("_sketches") > 0, F.kll_sketch_get_quantile_double("_quantile", F.lit(0.5)))
    return merged.select(
        "column_name",
        "known_values",
        F.hll_sketch_estimate("_distinct").alias("distinct_estimate"),
        F.when(F.col("_nan") * 2 > F.col("known_values"), float("nan")).otherwise(median).alias("median_estimate"),
    )


def one_profile(tables):
    """The merged profile of sketches kept in several tables."""
    return merged_profile(reduce(lambda a, b: a.unionByName(b), tables))
