"""Frequent and smallest values of columns by summaries of bounded size, one per partition.

Where `profile.value_counts` shuffles every distinct value, these send a summary per partition and
column: what is shuffled grows with the number of partitions and not with the rows.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.operators import profile
from marketlens.session import stored

#: Values that a partition's summary of frequent values holds per column.
CAPACITY = 256


def _texts(df, columns):
    """The columns as texts, as the profile shows them, under the names _0, _1 and so on."""
    cells = []
    for i, name in enumerate(columns):
        c = profile._quoted(name)
        is_float = df.schema[name].dataType.simpleString() in ("double", "float")
        cells.append((c + F.lit(0.0) if is_float else c).cast("string").alias(f"_{i}"))
    return df.select(*cells)


def _emitted(rows, schema):
    yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _smallest(columns, k):
    schema = pa.schema([("column_name", pa.string()), ("value", pa.string())])

    def summarize(batches):
        held = [pa.array([], pa.string())] * len(columns)
        for batch in batches:
            for i, column in enumerate(batch.columns):
                known = pc.drop_null(pa.concat_arrays([held[i], pc.unique(column)]))
                order = pc.sort_indices(known.cast(pa.binary()))
                held[i] = pc.unique(known.take(order))[:k]
        yield from _emitted(
            [{"column_name": c, "value": v} for c, values in zip(columns, held) for v in values.to_pylist()], schema
        )

    return summarize


def smallest_values(df, k=5):
    """The first k distinct values, as text, of every column: rows (column_name, rank, value).

    Every partition sends its k smallest; the k smallest of those are the ones of the table.
    """
    found = _texts(df, df.columns).mapInArrow(_smallest(df.columns, k), "column_name string, value string")
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy("value"))
    return found.distinct().withColumn("rank", rank).filter(F.col("rank") <= k).select("column_name", "rank", "value")


def reduced(values, counts, capacity):
    """At most `capacity` of the values, with lower bounds of their counts, and by how much a
    count can be larger than its bound (the count itself, for a value that is left out)."""
    if len(counts) <= capacity:
        return values, counts, 0
    error = int(np.partition(counts, -(capacity + 1))[-(capacity + 1)])
    kept = np.flatnonzero(counts > error)
    return values.take(pa.array(kept)), counts[kept] - error, error


def _frequent(columns, capacity):
    schema = pa.schema(
        [("column_name", pa.string()), ("value", pa.string()), ("least", pa.int64()), ("error", pa.int64()), ("known", pa.int64())]
    )

    def summarize(batches):
        held = [(pa.array([], pa.string()), np.zeros(0, np.int64)) for _ in columns]
        errors, known = [0] * len(columns), [0] * len(columns)
        for batch in batches:
            for i, column in enumerate(batch.columns):
                found = pc.value_counts(pc.drop_null(column))
                values, counts = found.field("values"), found.field("counts").to_numpy()
                known[i] += int(counts.sum())
                # A summary of the batch first: of many rare values hardly one is left to merge.
                values, counts, error = reduced(values, counts, capacity)
                both = pa.concat_arrays([held[i][0], values]).dictionary_encode()
                sums = np.bincount(
                    both.indices.to_numpy(), np.concatenate([held[i][1], counts]), len(both.dictionary)
                ).astype(np.int64)
                values, counts, more = reduced(both.dictionary, sums, capacity)
                held[i] = values, counts
                errors[i] += error + more
        rows = []
        for name, (values, counts), error, n in zip(columns, held, errors, known):
            rows.append({"column_name": name, "error": error, "known": n})
            rows += [{"column_name": name, "value": v, "least": int(c)} for v, c in zip(values.to_pylist(), counts)]
        yield from _emitted(rows, schema)

    return summarize


def frequent_values(df, k=5, capacity=CAPACITY):
    """The k most frequent values of every text or boolean column, ties by value; exact.

    Misra-Gries summaries of the partitions are added up. They tell each value's count to within
    the sum of their errors, and bound the count of every value that they don't name. The
    candidates are counted exactly. If the k-th of them is more frequent than that bound, or if
    they are all there is, they are the answer; only columns where neither holds (ids, say) are
    counted value by value. `capacity` changes how often that happens, never the result.
    """
    columns = profile._columns(df, profile.CATEGORICAL)
    if not columns:
        return profile.most_common_values(df, k)
    summaries = stored(
        _texts(df, columns).mapInArrow(
            _frequent(columns, capacity),
            "column_name string, value string, least bigint, error bigint, known bigint",
        ),
        "frequent_summaries",
    )
    totals = summaries.groupBy("column_name").agg(F.sum("error").alias("error"), F.sum("known").alias("known"))
    sums = summaries.filter("value IS NOT NULL").groupBy("column_name", "value").agg(F.sum("least").alias("least"))
    by_count = Window.partitionBy("column_name").orderBy(F.desc("least"), "value")
    named = sums.withColumn("rank", F.row_number().over(by_count)).filter(F.col("rank") <= capacity + 1)
    # The one after the last candidate bounds all that are left out.
    bounds = named.groupBy("column_name").agg(
        F.coalesce(F.max(F.when(F.col("rank") > capacity, F.col("least"))), F.lit(0)).alias("left_out")
    )
    bounds = stored(
        totals.join(bounds, "column_name", "left").select(
            "column_name", "known", "error", (F.col("error") + F.coalesce("left_out", F.lit(0))).alias("bound")
        ),
        "frequent_bounds",
    )
    candidates = named.filter(F.col("rank") <= capacity).select("column_name", "value", "least")
    # A handful of rows: one per column.
    bound = {row["column_name"]: row for row in bounds.collect()}
    inexact = [c for c in columns if c in bound and bound[c]["bound"] > 0]
    exact = candidates.filter(~F.col("column_name").isin(inexact)).withColumnRenamed("least", "n")
    if inexact:
        counted = stored(_recounted(df, inexact, candidates), "frequent_counts")
        ranked = counted.groupBy("column_name").agg(
            F.sum("n").alias("sum"), F.get(F.sort_array(F.collect_list("n"), asc=False), F.lit(k - 1)).alias("kth")
        )
        certain = [
            row["column_name"]
            for row in ranked.collect()
            if row["sum"] == bound[row["column_name"]]["known"] or (row["kth"] or 0) > bound[row["column_name"]]["bound"]
        ]
        exact = exact.unionByName(counted.filter(F.col("column_name").isin(certain)))
        rest = [c for c in inexact if c not in certain]
        if rest:
            exact = exact.unionByName(profile.value_counts(df, rest))
    return profile._leading(exact, k, F.desc("n"), "value").select(
        "column_name", "rank", "value", F.col("n").alias("frequency")
    )


def _recounted(df, columns, candidates):
    """Exact counts of the candidates, at most `capacity` per column, in one scan."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("value")) for i, c in enumerate(columns)])
    rows = _texts(df, columns).select(F.inline(cells))
    wanted = candidates.filter(F.col("column_name").isin(columns)).select("column_name", "value")
    return rows.join(F.broadcast(wanted), ["column_name", "value"]).groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
