"""The seven source files as typed DataFrames."""

from pyspark.sql import functions as F

from marketlens.functions.guards import require_columns
from marketlens.schema import SOURCES


#: Sources whose texts can hold line breaks inside quotes. A file of these is read in one piece,
#: so large ones should come as many files; `whole_files` finds them before anything is read.
MULTILINE = ("reviews",)


def required_files(spark, folder, files=None):
    """Path of each source file; one error that lists every file that is missing.

    `files` maps a logical name to a file name; the default is `<name>.csv`.
    """
    files = files or {}
    paths = {name: f"{folder}/{files.get(name, name + '.csv')}" for name in SOURCES}
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    missing = []
    for path in paths.values():
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop_path.getFileSystem(conf).exists(hadoop_path):
            missing.append(path)
    if missing:
        listing = "\n".join(f"- {path}" for path in missing)
        raise FileNotFoundError(f"The following required source files are missing:\n{listing}")
    return paths


def source_files(spark, paths, multiline=MULTILINE):
    """Rows (source, file, n_bytes, is_split) of the files behind each source.

    Only listed, not read. `is_split` is false for a file that one task has to read whole: its
    source can hold line breaks in quotes, or it is compressed in a form that has no block borders.
    """
    listed = None
    for name, path in paths.items():
        file = F.col("path")
        packed = F.lower(file).rlike(r"\.(gz|gzip|deflate|zst|snappy|lz4)$")
        one = (
            spark.read.format("binaryFile")
            .load(path)
            .select(
                F.lit(name).alias("source"),
                file.alias("file"),
                F.col("length").alias("n_bytes"),
                (F.lit(name not in multiline) & ~packed).alias("is_split"),
            )
        )
        listed = one if listed is None else listed.unionByName(one)
    return listed


def whole_files(spark, paths, over_bytes=1 << 30, multiline=MULTILINE):
    """The files larger than `over_bytes` that a single task would have to read, largest first."""
    files = source_files(spark, paths, multiline)
    return files.filter(~F.col("is_split") & (F.col("n_bytes") > over_bytes)).orderBy(
        F.desc("n_bytes"), "file"
    )


def read_csv_source(spark, name, path, on_bad_value="fail", multiline=MULTILINE):
    """One headered CSV; columns are found by name and cast to the known types.

    No inference pass. `on_bad_value="null"` turns a value that does not parse into NULL
    (`bad_value_counts` counts those); "fail" stops the job. `multiline` names the sources that
    can hold line breaks inside quotes; files of other sources are split between tasks.
    """
    raw = read_raw_csv(spark, path, name in multiline)
    fields = SOURCES[name].fields
    require_columns(raw, [f.name for f in fields])
    if on_bad_value not in ("fail", "null"):
        raise ValueError("on_bad_value must be 'fail' or 'null'.")
    cast = "cast" if on_bad_value == "fail" else "try_cast"
    return raw.select(*[getattr(F.col(f.name), cast)(f.dataType).alias(f.name) for f in fields])


def _csv_reader(spark, multiline):
    return spark.read.option("header", True).option("escape", '"').option("multiLine", multiline)


def read_raw_csv(spark, path, multiline=False):
    return _csv_reader(spark, multiline).csv(path)


MALFORMED = "_corrupt_record"


def _with_widths(spark, name, path, multiline):
    """The first field of every record, the record itself if it is malformed, and their widths."""
    header = read_raw_csv(spark, path, name in multiline).columns
    quoted = [f"`{c.replace('`', '``')}`" for c in header]
    schema = ", ".join(f"{c} string" for c in quoted) + f", {MALFORMED} string"
    # Without pruning: a record is only judged by the columns that are parsed.
    reader = _csv_reader(spark, name in multiline).schema(schema).option("columnPruning", False)
    rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", MALFORMED).csv(path)
    # A comma counts outside quotes only: what is quoted is taken away first.
    bare = F.regexp_replace(MALFORMED, '"([^"]|"")*"', "")
    return rows.select(
        F.col(quoted[0]).alias("first_field"),
        MALFORMED,
        F.size(F.split(bare, ",")).alias("n_fields"),
        F.lit(len(header)).alias("expected_fields"),
    )


def malformed_rows(spark, name, path, multiline=MULTILINE):
    """Records of a source file that don't have as many fields as its header.

    Columns first_field, `_corrupt_record` (the record as it stands in the file), n_fields and
    expected_fields. The reader fills a short record with NULLs and cuts a long one; neither is an
    error to it unless it is given a schema and a column for such records, as here. An empty line
    is no record.
    """
    return _with_widths(spark, name, path, multiline).filter(F.col(MALFORMED).isNotNull())


def malformed_counts(spark, paths, multiline=MULTILINE):
    """Per source, in one scan: records as wide as the header, shorter and longer ones, and those
    whose first field, the key of most sources, is empty."""
    counted = None
    for name, path in paths.items():
        is_bad = F.col(MALFORMED).isNotNull()
        width, expected = F.col("n_fields"), F.col("expected_fields")
        one = (
            _with_widths(spark, name, path, multiline)
            .agg(
                F.count_if(~is_bad).alias("good_rows"),
                F.count_if(is_bad & (width < expected)).alias("too_few_fields"),
                F.count_if(is_bad & (width > expected)).alias("too_many_fields"),
                F.count_if(F.col("first_field").isNull()).alias("without_key"),
            )
            .select(F.lit(name).alias("source"), "*")
        )
        counted = one if counted is None else counted.unionByName(one)
    return counted


def bad_value_counts(spark, name, path, multiline=MULTILINE):
    """Rows (column_name, bad_values) of values present in the file that do not parse."""
    raw = read_raw_csv(spark, path, name in multiline)
    fields = SOURCES[name].fields
    require_columns(raw, [f.name for f in fields])
    counts = raw.agg(
        *[
            F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull())
            .alias(f.name)
            for f in fields
        ]
    )
    return counts.unpivot([], [f.name for f in fields], "column_name", "bad_values")


def read_staging(spark, paths, on_bad_value="fail", multiline=MULTILINE):
    """All sources by logical name, each also a temporary view `raw_<name>`."""
    staging = {}
    for name, path in paths.items():
        staging[name] = read_csv_source(spark, name, path, on_bad_value, multiline)
        staging[name].createOrReplaceTempView(f"raw_{name}")
    return staging
