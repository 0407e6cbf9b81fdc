"""Exact medians of columns with very many distinct values."""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.session import stored

#: Bits that the first, second and third look at the codes tell apart. No step puts more than
#: 2 ** 22 counters of a key in one task.
STEPS = (22, 21, 21)


def sort_code(c, data_type):
    """A bigint that grows with the number, so that whole numbers can be compared instead.

    Exact for every type but decimals of more than 18 digits, which are taken as doubles. A NaN
    is larger than all other numbers, the zeros are equal.
    """
    if isinstance(data_type, T.IntegralType):
        return c.cast("bigint")
    if isinstance(data_type, T.DecimalType) and data_type.precision <= 18:
        scale = data_type.scale
        return (c.cast(f"decimal(38,{scale})") * F.lit(10**scale)).cast("bigint")
    return _double_code(c.cast("double"))


def _double_code(v):
    """Exponent and fraction as IEEE 754 orders them, computed with exact operations only."""
    size = F.abs(v)
    guess = F.floor(F.log2(size)).cast("int")
    power = F.pow(F.lit(2.0), guess)
    # The logarithm is off by one at times next to a power of two.
    exponent = F.when(size < power, guess - 1).when(size / 2 >= power, guess + 1).otherwise(guess)
    fraction = (size / F.pow(F.lit(2.0), exponent) - 1) * F.lit(2.0**52)
    normal = (exponent + 1023).cast("bigint") * F.lit(2**52) + fraction.cast("bigint")
    tiny = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("bigint")
    infinite = F.lit(2047 * 2**52)
    code = (
        F.when(F.isnan(v), infinite + 1)
        .when(size == float("inf"), infinite)
        .when(size < 2.0**-1022, tiny)
        .otherwise(normal)
    )
    return F.when((v < 0) & ~F.isnan(v), -code).otherwise(code)


def exact_median(counts, keys, small_keys=False):
    """Median per `keys` of a table (keys, code, value, n) that counts distinct values.

    `code` is a `sort_code`, `value` the number as a double. The built-in median keeps all
    distinct values of a group in one task. Here the two middle ranks are followed down in three
    steps, each a histogram of the next bits of the codes that begin like the middle ones.
    `small_keys` states that the keys have few, fixed values.
    """
    counts = counts.filter(F.col("code").isNotNull())
    state, bits = None, 64
    for step in STEPS:
        before, bits = bits, bits - step
        rows = counts.select(*keys, "n", F.shiftright("code", bits).alias("_digit"), "code")
        if state is None:
            histogram = rows.groupBy(*keys, "_digit").agg(F.sum("n").alias("n"))
            total = F.sum("n").over(Window.partitionBy(*keys))
            ranks = F.array(
                *[
                    F.struct(F.lit(i).alias("which"), F.floor((total + 1 + i) / 2).alias("rank"))
                    for i in (0, 1)
                ]
            )
            histogram = histogram.withColumn("_ranks", ranks).select(
                *keys, "_digit", "n", F.inline("_ranks").alias("_which", "_rank")
            )
        else:
            marked = rows.withColumn("_prefix", F.shiftright("code", before))
            # Two rows per key
            middle = F.broadcast(state) if small_keys else state
            histogram = (
                marked.join(middle, [*keys, "_prefix"])
                .groupBy(*keys, "_which", "_rank", "_digit")
                .agg(F.sum("n").alias("n"))
            )
        upto = F.sum("n").over(Window.partitionBy(*keys, "_which").orderBy("_digit"))
        state = (
            histogram.withColumn("_upto", upto)
            .filter((F.col("_upto") - F.col("n") < F.col("_rank")) & (F.col("_rank") <= F.col("_upto")))
            .select(
                *keys,
                "_which",
                (F.col("_rank") - F.col("_upto") + F.col("n")).alias("_rank"),
                F.col("_digit").alias("_prefix"),
            )
        )
    values = counts.select(*keys, F.col("code").alias("_prefix"), "value")
    middle = F.broadcast(state) if small_keys else state
    found = values.join(middle, [*keys, "_prefix"])
    low, high = F.min("value"), F.max("value")
    middle = (low + high) / 2
    # The sum of two very large numbers may be too large.
    middle = F.when(F.abs(middle) == float("inf"), low / 2 + high / 2).otherwise(middle)
    return found.groupBy(*keys).agg(middle.alias("median"))


def value_counts(df, keys, column):
    """Stored table (keys, code, value, n) of the distinct known values of one numeric column."""
    kind = df.schema[column].dataType
    kind = T.IntegerType() if isinstance(kind, T.BooleanType) else kind
    known = df.filter(F.col(column).isNotNull())
    counted = known.groupBy(*keys, sort_code(F.col(column), kind).alias("code")).agg(
        F.max(F.col(column).cast("double")).alias("value"), F.count(F.lit(1)).alias("n")
    )
    return stored(counted, "value_counts")
