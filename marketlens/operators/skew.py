"""Equi-join of a large table to a keyed one when some keys hold much of the large table."""

from pyspark.sql import functions as F

from marketlens.session import stored

SALT = "_salt"
#: A key is hot if it alone holds more than this share of what a task gets on average.
SHARE_OF_TASK = 0.5
#: A list of more hot keys is not broadcast: with `rows_per_salt` given, it grows with the table.
BROADCAST_KEYS = 100_000


def hot_keys(df, key, rows_per_salt=None):
    """All keys with more than `rows_per_salt` rows, and over how many salts each is spread.

    By default that is SHARE_OF_TASK of the rows per shuffle partition, so there are at most
    partitions / SHARE_OF_TASK hot keys, however large the table is. The counts are exact, made of
    partial counts, and the result is a stored table: both sides of the join read the same one.
    """
    spark = df.sparkSession
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    if rows_per_salt is None:
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        total = df.agg(F.count(key)).first()[0]
        rows_per_salt = max(1.0, SHARE_OF_TASK * total / tasks)
    salts = F.ceil(F.col("_rows") / F.lit(float(rows_per_salt))).cast("int")
    hot = counts.filter(F.col("_rows") > rows_per_salt).select(key, salts.alias("_salts"))
    return stored(hot, "hot_keys")


def listed(hot):
    """A stored list of hot keys, to be broadcast if it is short; else its size decides, as of any table."""
    return F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot


def _marked(df, hot, key):
    # Keys with more than n rows are fewer than rows / n: by default a few per task.
    return df.join(listed(hot), key, "left")


def salt_rows(df, hot, key):
    """Spread the rows of hot keys over their salts; every other row gets salt 0.

    The row number within the partition, not a hash of the row, picks the salt, so that copies
    of one row spread as well. `df` has to be a scan or a projection of one: then a rerun task
    sees its rows in the same order and gives each the same salt.
    """
    numbered = df.withColumn("_number", F.monotonically_increasing_id())
    salt = F.pmod(F.col("_number"), F.col("_salts").cast("bigint")).cast("int")
    return (
        _marked(numbered, hot, key)
        .withColumn(SALT, F.coalesce(salt, F.lit(0)))
        .drop("_salts", "_number")
    )


def replicate_keyed(df, hot, key):
    """One row of `df` per salt of its key; rows of other keys stay single."""
    last = F.coalesce(F.col("_salts"), F.lit(1)) - 1
    marked = _marked(df, hot, key)
    return marked.withColumn(SALT, F.explode(F.sequence(F.lit(0), last))).drop("_salts")
