"""Positions of rows in a sorted table, without one task per group."""

from marketlens.llm.runtime import stored
from pyspark.sql import Window
from pyspark.sql import functions as F


def ranked(df, group, order, name):
    """Stored rows of `df` with `row_no` (unique), `place` (from 0 in the group) and `group_rows`.

    `group` and `order` name columns; nulls come first and form a group of their own. Rows are
    dealt by ranges of both, and rows that agree in all of them by their number too, so that a
    group, or copies of one row, may hold most of the table. What is brought together is one row
    per group and partition.
    """
    numbered = df.withColumn("row_no", F.monotonically_increasing_id())
    keys = [*group, *order, "row_no"]
    dealt = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = stored(
        dealt.withColumn("row_no", F.monotonically_increasing_id()).withColumn(
            "_part", F.spark_partition_id()
        ),
        name,
    )
    parts = rows.groupBy(*group, "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("row_no").alias("_first")
    )
    around = Window.partitionBy(*group)
    before = around.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *[F.col(c).alias(f"_{c}") for c in group],
        F.col("_part").alias("_of"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(around).alias("group_rows"),
    )
    same = F.col("_part") == F.col("_of")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(parts, same).select(
        *df.columns, "row_no", (F.col("row_no") + F.col("_shift")).alias("place"), "group_rows"
    )
