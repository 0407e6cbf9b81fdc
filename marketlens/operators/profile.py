"""Column profiles of any flat table.

Two passes serve every statistic. The first only aggregates. The second counts the distinct
values of all columns at once; distinct counts, frequent values, samples and medians all come
from those counts.
"""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.functions.columns import ratio, round2
from marketlens.operators.median import exact_median, sort_code
from marketlens.session import stored

NUMERIC, TEMPORAL, CATEGORICAL = "numeric", "temporal", "categorical"


def column_kind(data_type):
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType, T.TimeType)):
        return TEMPORAL
    return CATEGORICAL


def _columns(df, *kinds):
    return [f.name for f in df.schema.fields if column_kind(f.dataType) in kinds]


def _quoted(name):
    return F.col("`" + name.replace("`", "``") + "`")


def _counted_as(f):
    """The type in which the values of a column are counted: its own if equal values have one text."""
    kind = f.dataType
    if isinstance(kind, T.IntegralType):
        return T.LongType()
    own = (T.DoubleType, T.FloatType, T.DecimalType, T.DateType, T.TimestampNTZType)
    return kind if isinstance(kind, own) else T.StringType()


def _counted(df, fields, kind):
    """Rows (column_name, value as text, n, code, number) of columns counted as one type."""
    cells = []
    for i, f in enumerate(fields):
        c = _quoted(f.name).cast(kind)
        # Adding zero makes the two double zeros one value.
        c = c + F.lit(0.0).cast(kind) if isinstance(kind, (T.DoubleType, T.FloatType)) else c
        cells.append(F.struct(F.lit(i).alias("_column"), c.alias("value")))
    counted = (
        df.select(F.inline(F.array(*cells)))
        .filter(F.col("value").isNotNull())
        .groupBy("_column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    names = F.array(*[F.lit(f.name) for f in fields])
    number = isinstance(kind, T.NumericType)
    return counted.select(
        F.get(names, F.col("_column")).alias("column_name"),
        F.col("value").cast("string").alias("value"),
        "n",
        (sort_code(F.col("value"), kind) if number else F.lit(None).cast("bigint")).alias("code"),
        (F.col("value") if number else F.lit(None)).cast("double").alias("number"),
    )


def counted_values(df, columns=None):
    """`value_counts`, and of numbers their sort code and themselves as doubles.

    The columns of one type are counted together, as that type: a number or a time has a key of
    eight bytes, and only its distinct values become texts. A column that no task has to hold
    beside those of all other types also needs less memory.
    """
    by_type = {}
    for f in df.schema.fields:
        if columns is None or f.name in columns:
            by_type.setdefault(_counted_as(f), []).append(f)
    if not by_type:
        schema = "column_name string, value string, n bigint, code bigint, number double"
        return df.sparkSession.createDataFrame([], schema)
    counted = [_counted(df, fields, kind) for kind, fields in by_type.items()]
    return reduce(lambda a, b: a.unionByName(b), counted)


def value_counts(df, columns=None):
    """Rows (column_name, value as text, n) of the distinct known values of the columns."""
    return counted_values(df, columns).select("column_name", "value", "n")


def column_counts(df, counts=None):
    """Per column: type, NULLs, distinct values and their shares of the rows (0 if no rows)."""
    per_column = df.agg(F.count(F.lit(1)).alias("_rows")).select(
        "_rows",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i + 1).alias("position"),
                        F.lit(f.name).alias("column_name"),
                        F.lit(f.dataType.simpleString()).alias("database_type"),
                    )
                    for i, f in enumerate(df.schema.fields)
                ]
            )
        ),
    )
    distinct = (
        (counts if counts is not None else value_counts(df))
        .groupBy("column_name")
        .agg(F.count(F.lit(1)).alias("unique_count"), F.sum("n").alias("_known"))
    )
    rows = F.col("_rows")
    nulls = rows - F.coalesce("_known", F.lit(0))
    unique = F.coalesce("unique_count", F.lit(0))
    return per_column.join(distinct, "column_name", "left").select(
        "position",
        "column_name",
        "database_type",
        nulls.alias("null_count"),
        F.coalesce(round2(ratio(nulls, rows) * 100), F.lit(0.0)).alias("null_percentage"),
        unique.alias("unique_count"),
        F.coalesce(F.round(ratio(unique, rows) * 10000) / 10000, F.lit(0.0)).alias(
            "cardinality_ratio"
        ),
    )


def _per_column(df, columns, kind, statistics):
    """One aggregate pass, turned to one row per column; `statistics` maps name to function."""
    if not columns:
        schema = "column_name string, " + ", ".join(f"{s} {kind}" for s in statistics)
        return df.sparkSession.createDataFrame([], schema)
    wide = df.agg(
        *[
            function(_quoted(name)).alias(f"_{i}_{statistic}")
            for i, name in enumerate(columns)
            for statistic, function in statistics.items()
        ]
    )
    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("column_name"),
                        *[F.col(f"_{i}_{s}").alias(s) for s in statistics],
                    )
                    for i, name in enumerate(columns)
                ]
            )
        )
    )


def numeric_statistics(df, counts=None):
    """Minimum, maximum, mean and exact median of every numeric column.

    `counts` are the stored `counted_values` of the table, if there are any.
    """
    columns = _columns(df, NUMERIC)
    bounds = _per_column(
        df,
        columns,
        "double",
        {
            "minimum": lambda c: F.min(c).cast("double"),
            "maximum": lambda c: F.max(c).cast("double"),
            "mean": lambda c: F.avg(c).cast("double"),
        },
    )
    counts = counts if counts is not None else stored(counted_values(df, columns), "value_counts")
    numbers = counts.filter(F.col("column_name").isin(columns)).select(
        "column_name", "code", F.col("number").alias("value"), "n"
    )
    medians = exact_median(numbers, ["column_name"], small_keys=True)
    return bounds.join(medians, "column_name", "left")


def temporal_statistics(df):
    """Earliest and latest value, as text, of every date or time column."""
    return _per_column(
        df,
        _columns(df, TEMPORAL),
        "string",
        {
            "minimum": lambda c: F.min(c).cast("string"),
            "maximum": lambda c: F.max(c).cast("string"),
        },
    )


def _leading(counts, k, *order):
    # The rank limit is applied before the shuffle too, so a column of many values does not
    # end up in one task.
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(*order))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def most_common_values(df, k=5, counts=None):
    """The k most frequent values of every text or boolean column; ties by value."""
    columns = _columns(df, CATEGORICAL)
    counts = counts if counts is not None else value_counts(df, columns)
    return _leading(
        counts.filter(F.col("column_name").isin(columns)), k, F.desc("n"), "value"
    ).select("column_name", "rank", "value", F.col("n").alias("frequency"))


def sample_values(df, k=5, counts=None):
    """k distinct values of every column, the first ones as text, so that runs agree."""
    counts = counts if counts is not None else value_counts(df)
    return _leading(counts, k, "value").select("column_name", "rank", "value")


def profile_table(df):
    """One row per column with all of the above; statistics that do not apply are NULL."""
    # One folder per column, so each statistic reads the columns it is about.
    counts = stored(counted_values(df), "value_counts", "column_name").select(
        "column_name", "value", "n", "code", "number"
    )

    def collected(rows, entry, name):
        ordered = F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry"))))
        return rows.groupBy("column_name").agg(
            F.transform(ordered, lambda r: r["entry"]).alias(name)
        )

    numbers = numeric_statistics(df, counts).select(
        "column_name",
        F.struct(
            F.col("minimum").cast("string").alias("minimum"),
            F.col("maximum").cast("string").alias("maximum"),
            "mean",
            "median",
        ).alias("statistics"),
    )
    unknown = F.lit(None).cast("double")
    times = temporal_statistics(df).select(
        "column_name",
        F.struct(
            "minimum",
            "maximum",
            unknown.alias("mean"),
            unknown.alias("median"),
        ).alias("statistics"),
    )
    samples = collected(sample_values(df, counts=counts), F.col("value"), "sample_values")
    common = collected(
        most_common_values(df, counts=counts),
        F.struct("value", "frequency"),
        "most_common_values",
    )
    # All of these have one row per column of the table.
    return (
        column_counts(df, counts)
        .join(F.broadcast(samples), "column_name", "left")
        .join(F.broadcast(numbers.unionByName(times)), "column_name", "left")
        .join(F.broadcast(common), "column_name", "left")
        .orderBy("position")
    )
