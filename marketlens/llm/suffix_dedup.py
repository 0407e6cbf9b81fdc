"""Exact substring dedup by suffix arrays: bytes of long strings that occur earlier are removed.

Texts go through a candidate search first (`anchors`): a 100-byte string can only be repeated
where its anchor is, so most of the text never reaches a suffix array, and equal regions settle
to their first occurrence. Each remaining region lies in the shard of its anchor together with
all other regions that can hold the same strings. A shard is sorted as one suffix array, common
prefixes tell which strings are equal, and the first in the order of the documents stays.
An anchor with very many different regions has several shards; each sends the strings that it
has kept, sorted by hash, and they are merged by binary search.
"""

import hashlib

import numpy as np
import pyarrow as pa
from marketlens.llm import anchors, suffixes, textbytes
from marketlens.llm.runtime import keyed, keyed_rows, stored
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 100
GRAM = 20
BLOCK_BYTES = 1 << 20
SLICE_BYTES = 4 << 20

_COMPARED = "key long, variant long, start int, size int, high long, low long, shard int"


def _symbols(gram):
    def of(data, offsets):
        sums = textbytes.RangeHash(data)
        n = max(len(data) - gram + 1, 0)
        at = np.arange(n)
        return data, sums.of(at, at + gram), offsets

    return of


def _cut(data, offsets, text, starts, sizes):
    at = offsets[text] + starts
    pieces = textbytes.gather(data, at, sizes)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    return pa.Array.from_buffers(
        pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(pieces)]
    ).cast(pa.binary())


def _compare(window):
    """Of a block of regions, the stretches that repeat an earlier string of their shard."""

    def compare(batch):
        data, offsets = textbytes.flat(batch.column(7))
        n_rows = batch.num_rows
        row = np.repeat(np.arange(n_rows), np.diff(offsets))
        order = suffixes.suffix_array(data)
        shared = suffixes.common_prefixes(data, order)
        # Strings are told apart where fewer than `window` bytes are shared. Only those inside a
        # region count; they don't reach into the next one.
        start = np.arange(len(data)) <= offsets[row + 1] - window
        inside = start[order]
        class_of = np.cumsum(shared < window)[inside]
        position = order[inside]
        own = [batch.column(i).to_numpy() for i in (0, 2)]
        shard = np.cumsum(anchors.first_of_runs(*own))[row[position]]
        by_class = np.lexsort((position, shard, class_of))
        position, shard, class_of = position[by_class], shard[by_class], class_of[by_class]
        new = anchors.first_of_runs(class_of, shard)
        # A shard is sorted by document and start; a block can hold several shards of an anchor.
        repeated = np.zeros(len(data), bool)
        repeated[position[~new]] = True
        columns = _stretches(batch, offsets, row, repeated, window)
        shards = batch.column(1).to_numpy()
        rest = np.flatnonzero(new)
        rest = position[rest[shards[row[position[rest]]] > 1]]
        if not len(rest):
            return columns
        rest.sort()
        high = textbytes.RangeHash(data).of(rest, rest + window).view(np.int64)
        low = textbytes.RangeHash(data, 1).of(rest, rest + window).view(np.int64)
        names = [batch.column(i).to_numpy()[row[rest]] for i in (3, 4, 5, 2)]
        kept = pa.RecordBatch.from_arrays(
            [
                pa.array(names[0]),
                pa.array(names[1]),
                pa.array((names[2] + rest - offsets[row[rest]]).astype(np.int32)),
                pa.array(np.full(len(rest), window, np.int32)),
                pa.array(high),
                pa.array(low),
                pa.array(names[3]),
            ],
            columns.schema.names,
        )
        return pa.Table.from_batches([columns, kept]).combine_chunks().to_batches()[0]

    return compare


def _stretches(batch, offsets, row, repeated, window):
    """Rows for maximal runs of string starts in a region; shard -1: settled."""
    begin, end, region = textbytes.runs(repeated, offsets)
    nothing = pa.nulls(len(begin), pa.int64())
    starts = batch.column(5).to_numpy()[region] + begin - offsets[region]
    return pa.RecordBatch.from_arrays(
        [
            batch.column(3).take(pa.array(region)),
            batch.column(4).take(pa.array(region)),
            pa.array(starts.astype(np.int32)),
            pa.array((end - begin + window - 1).astype(np.int32)),
            nothing,
            nothing,
            pa.array(np.full(len(begin), -1, np.int32)),
        ],
        ["key", "variant", "start", "size", "high", "low", "shard"],
    )


def merged_by_binary_search(kept):
    """Of the strings that several shards kept, those that aren't the first: covered stretches.

    Strings come sorted by document within a hash range, and each batch is looked up in the
    sorted hashes of the strings met before it.
    """
    near = kept.repartition("high").sortWithinPartitions("key", "variant", "start")

    def merge(batches):
        met = np.empty(0, [("high", np.int64), ("low", np.int64)])
        for batch in batches:
            names = np.empty(batch.num_rows, met.dtype)
            names["high"], names["low"] = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            distinct, first = np.unique(names, return_index=True)
            again = np.ones(len(names), bool)
            again[first] = False
            if len(met):
                place = np.minimum(np.searchsorted(met, distinct), len(met) - 1)
                known = met[place] == distinct
                again[first[known]] = True
                distinct = distinct[~known]
            met = np.insert(met, np.searchsorted(met, distinct), distinct)
            which = pa.array(np.flatnonzero(again))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).take(which) for i in range(4)],
                ["key", "variant", "start", "size"],
            )

    return near.mapInArrow(merge, anchors.COVERED)


def repeated_stretches(docs, window=WINDOW, gram=GRAM):
    """(stored stretches that are covered by earlier strings, for documents as of `keyed`)."""
    found = anchors.found_regions(docs, _symbols(gram), window, gram, keep_first=True)
    settled = stored(anchors.settled_regions(found, keep_first=True), "repeats-settled")
    cut = anchors.cut_out(settled, docs, _cut, "binary")
    compared = stored(
        anchors.compared_in_blocks(cut, _compare(window), _COMPARED, BLOCK_BYTES), "repeats-compared"
    )
    names = ["key", "variant", "start", "size"]
    merged = merged_by_binary_search(compared.filter("shard >= 0"))
    return (
        settled.filter("covered")
        .select(names)
        .unionByName(compared.filter("shard < 0").select(names))
        .unionByName(merged)
    )


def _removed_spans(n_bytes, starts, sizes):
    covered = anchors.covered_positions(n_bytes, starts, sizes)
    edges = np.diff(np.concatenate(([0], covered.astype(np.int8), [0])))
    return covered, np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def with_stretches(docs, covered):
    """Every row of keyed documents with its list of covered stretches, null without any."""
    return docs.join(anchors.per_document(covered), ["key", "variant"], "left")


def _texts_and_stretches(batches, text, stretches):
    for part in textbytes.slices(batches, text, SLICE_BYTES):
        data, offsets = textbytes.flat(part.column(text))
        lists = part.column(stretches)
        ends = lists.offsets.to_numpy()
        fields = lists.values
        starts, sizes = fields.field(0).to_numpy(), fields.field(1).to_numpy()
        valid = lists.is_valid().to_numpy(zero_copy_only=False)
        for i in range(part.num_rows):
            low, high = (ends[i], ends[i + 1]) if valid[i] else (0, 0)
            yield part, i, data[offsets[i] : offsets[i + 1]], starts[low:high], sizes[low:high]


def remove_repeats(docs, id_col="doc_id", text_col="text", window=WINDOW):
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte ranges.

    A text is its UTF-8 bytes, a null text none; strings don't cross documents. Each byte covered
    by a `window`-byte string that starts earlier, in a smaller doc_id or before it in the same
    document, is removed. Rows that repeat an id with another text are documents of their own,
    ordered by a hash of the text; a row repeated whole is one document and has its result each
    time; rows without id come last. Texts shorter than `window` and empty tables are fine.
    """
    named = keyed(docs, id_col, text_col)
    covered = repeated_stretches(named, window)
    rows = with_stretches(named, covered).select("doc_id", "text", "stretches")

    def digest(batches):
        schema = pa.schema(
            [
                ("doc_id", pa.int64()),
                ("n_bytes", pa.int64()),
                ("n_removed", pa.int64()),
                ("n_spans", pa.int64()),
                ("kept_sha256", pa.string()),
                ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ]
        )
        held = []
        for part, i, data, starts, sizes in _texts_and_stretches(batches, 1, 2):
            gone, begin, end = _removed_spans(len(data), starts, sizes)
            held.append(
                {
                    "doc_id": part.column(0)[i].as_py(),
                    "n_bytes": len(data),
                    "n_removed": int(gone.sum()),
                    "n_spans": len(begin),
                    "kept_sha256": hashlib.sha256(data[~gone].tobytes()).hexdigest(),
                    "removed": [
                        {"start": int(a), "end": int(b)} for a, b in zip(begin, end, strict=True)
                    ],
                }
            )
            if len(held) >= 1000:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return rows.mapInArrow(
        digest,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "removed array<struct<start: long, end: long>>",
    )


def deduplicated(docs, id_col="doc_id", text_col="text", n_chars_col="n_chars", window=WINDOW):
    """All rows and columns of `docs` with repeated strings cut out of the texts.

    A character goes if all its bytes go. A null text stays null. `n_chars_col`, if there is such
    a column, is the new length.
    """
    rows, _ = keyed_rows(docs, id_col, text_col)
    covered = repeated_stretches(rows.drop("row"), window)
    joined = with_stretches(rows, covered).select("row", "text", "stretches")
    schema = T.StructType([joined.schema["row"], T.StructField("kept", T.StringType())])

    def cut(batches):
        held, part_held = [], None
        for part, i, data, starts, sizes in _texts_and_stretches(batches, 1, 2):
            if part is not part_held:
                if held:
                    yield _kept_batch(part_held, held)
                held, part_held = [], part
            if not len(starts):
                held.append(part.column(1)[i].as_py())
                continue
            gone = anchors.covered_positions(len(data), starts, sizes)
            lead = (data & 0xC0) != 0x80
            char = np.cumsum(lead) - 1
            stays = np.bincount(char, ~gone) > 0
            held.append(data[stays[char]].tobytes().decode())
        if held:
            yield _kept_batch(part_held, held)

    kept = joined.mapInArrow(cut, schema)
    columns = []
    for field in docs.schema.fields:
        if field.name == text_col:
            columns.append(F.col("kept").alias(text_col))
        elif field.name == n_chars_col:
            length = F.char_length("kept").cast(field.dataType)
            columns.append(F.coalesce(length, F.col("row").getField(n_chars_col)).alias(n_chars_col))
        else:
            columns.append(F.col("row").getField(field.name).alias(field.name))
    return kept.select(columns)


def _kept_batch(part, texts):
    return pa.RecordBatch.from_arrays(
        [part.column(0), pa.array(texts, pa.string())], ["row", "kept"]
    )

