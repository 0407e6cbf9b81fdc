"""Where a session may keep tables that every executor can reach."""

import contextlib
import tempfile
import uuid

#: No file of a stored table has more rows.
FILE_ROWS = 20_000_000
#: A task keeps so many folders open at once. Only the rows of further folders are sorted by folder.
OPEN_FOLDERS = 200
LEAN_WRITES = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FOLDERS),
}


def shared_folder(spark) -> str:
    """The folder named by `spark.checkpoint.dir`; on a local master, one of our own if unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
    folder = tempfile.mkdtemp(prefix="marketlens-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_table_path(spark, name) -> str:
    return f"{shared_folder(spark)}/marketlens/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def lean_writes(spark):
    """Writes inside take no more disk than they need; the settings are put back afterwards.

    The shuffles of a write go when it is done, where Spark would keep them until the driver next
    collects garbage, beside those of the steps that follow. Rows go to the open files of their
    folders as they come, without a sort that spills.
    """
    before = {key: spark.conf.get(key) for key in LEAN_WRITES}
    for key, value in LEAN_WRITES.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def stored(df, name, partition_by=None):
    """The rows of `df` as a table in the shared folder, computed once, now.

    For what several later steps read: a column filter or a partition filter of theirs would
    otherwise reach below the shuffle and make each of them compute it all again. Adaptive
    execution has sized the partitions of a shuffle already; each writes to the folders of its
    rows, so nothing is shuffled by folder.
    """
    path = new_table_path(df.sparkSession, name)
    rows = df.write.option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS)
    with lean_writes(df.sparkSession):
        (rows.partitionBy(partition_by) if partition_by else rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
