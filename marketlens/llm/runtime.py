"""What the operators share: shipping the library, stored tables, keyed documents, file systems."""

import os
import shutil
import tempfile

import marketlens
from marketlens.session import new_table_path
from pyspark.sql import functions as F

_shipped = set()

#: Stands for a missing document id inside an operator, so that such rows sort and join like others.
NO_ID = 2**63 - 1


def ship(spark):
    """Make the library importable in Python workers, once per application."""
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        package = os.path.dirname(os.path.abspath(marketlens.__file__))
        name = os.path.join(tempfile.mkdtemp(), "marketlens_llm")
        home, base = os.path.split(package)
        spark.sparkContext.addPyFile(shutil.make_archive(name, "zip", home, base))
        _shipped.add(application)


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df, name):
    """The rows of `df`, written once to the shared folder and read from there."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(docs, id_col="doc_id", text_col="text"):
    """Columns doc_id, text, key and variant; key and variant name a document and are never null.

    Rows that repeat an id with another text, and rows without an id, are documents of their own:
    variant is then a hash of the text, and 0 otherwise. A row that is repeated whole is the same
    document each time. Other columns are left out, so their names can't clash.
    """
    return keyed_rows(docs, id_col, text_col)[0].drop("row")


def keyed_rows(docs, id_col="doc_id", text_col="text"):
    """As `keyed`, with all columns of `docs` as struct `row`; and whether any id is repeated."""
    plain = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    ).withColumn("key", F.coalesce("doc_id", F.lit(NO_ID)))
    repeated = (
        plain.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") > 1) | (F.col("key") == NO_ID))
        .select("key", F.lit(True).alias("repeated"))
    )
    if repeated.isEmpty():
        return plain.withColumn("variant", F.lit(0).cast("long")), False
    own = F.when(F.col("repeated"), F.xxhash64(F.coalesce("text", F.lit(""))))
    variant = F.coalesce(own, F.lit(0).cast("long")).alias("variant")
    marked = plain.join(repeated, "key", "left")
    return marked.select("doc_id", "text", "row", "key", variant), True


def file_system(uri):
    """The Arrow file system of a folder and the path in it; any executor can call this."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)
