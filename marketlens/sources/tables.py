"""Write, read and describe the order-item table."""

from pyspark.errors import AnalysisException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from marketlens.operators import quality
from marketlens.operators.model import build_order_items
from marketlens.operators.reduce import orders_of
from marketlens.schema import ORDER_ITEMS
from marketlens.session import lean_writes
from marketlens.sources.staging import read_staging, required_files


MONTH = "purchase_month_start"


def write_order_items(df, path):
    """Replace the table at `path`, one folder per purchase month.

    The rebalance hint lets adaptive execution size the files: small months are merged into one
    task and a month that holds much of the data is split over many.
    """
    _write_by_month(df.hint("rebalance", MONTH), path)


def store_order_items(staging, path):
    """Build the table and write it as `write_order_items` does, with less to shuffle by month."""
    _write_by_month(build_order_items(staging, dealt_by=MONTH), path)


def _write_by_month(rows, path):
    months = rows.write.mode("overwrite").partitionBy(MONTH).option("compression", "zstd")
    with lean_writes(rows.sparkSession):
        months.parquet(path)


def write_validated(df, path):
    """As `write_order_items`; returns the validation report of what was written.

    The checks of values are observed by the tasks that write, so that only the two key columns are
    read again. A write that fails raises, and there is no report.
    """
    observation = Observation("order_item_checks")
    rows = df.hint("rebalance", MONTH).observe(observation, *quality.value_checks())
    _write_by_month(rows, path)
    return quality.report_of_write(read_order_items(df.sparkSession, path), observation.get)


def write_orders(items, path):
    """Replace the order-grain table at `path` with that of an order-item table."""
    with lean_writes(items.sparkSession):
        orders_of(items).write.mode("overwrite").parquet(path)


def read_order_items(spark, path):
    """The stored table; an error that says so if it was never built."""
    try:
        return spark.read.schema(ORDER_ITEMS).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(
            f"Order-item table not found: {path}. Build it with build_from_files first."
        ) from error


def build_from_files(spark, source_folder, table_path, files=None, on_bad_value="fail"):
    """Check the files, stage them, build the table, store it and return it."""
    paths = required_files(spark, source_folder, files)
    store_order_items(read_staging(spark, paths, on_bad_value), table_path)
    return read_order_items(spark, table_path)


def table_schema(df):
    """Rows (position, column_name, column_type)."""
    rows = [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "position int, column_name string, column_type string"
    )


def table_summary(df):
    """One row: row_count, column_count and the column list."""
    columns = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("column_type"),
        )
        for f in df.schema.fields
    ]
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count", F.lit(len(columns)).alias("column_count"), F.array(*columns).alias("columns")
    )
