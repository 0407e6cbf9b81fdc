"""Exact dedup of long word sequences: an FM-index per shard, and backward search in it.

A candidate search (`anchors`) comes first: a window can only be repeated where its anchor is,
and equal regions of text settle one another. The regions left are grouped in shards by anchor.
A shard's regions become one compressed index, a wavelet matrix over the Burrows-Wheeler
transform, and then stream through it: backward search tells the longest strings that occur
again, and those of a window or more are reported. An anchor with very many different regions has
several shards; for these, windows are also counted across shards by hash.
"""

import hashlib

import numpy as np
import pyarrow as pa
from marketlens.llm import anchors, textbytes
from marketlens.llm.fmindex import FMIndex
from marketlens.llm.runtime import keyed, stored
from marketlens.llm.suffix_dedup import _texts_and_stretches, with_stretches
from pyspark.sql import Window
from pyspark.sql import functions as F

WINDOW = 35
GRAM = 8
#: Words of a block of shards; its index is a few times as large.
BLOCK_WORDS = 120_000

_COMPARED = "key long, variant long, start int, size int, high long, low long, done boolean"


def words_of(data, offsets):
    """Hashes of all words, their byte ranges, and where the texts begin in them."""
    starts, ends, text = textbytes.runs(~textbytes.SPACE[data], offsets)
    hashes = textbytes.RangeHash(data).of(starts, ends)
    return hashes, starts, ends, np.searchsorted(text, np.arange(len(offsets)))


def _symbols(gram):
    def of(data, offsets):
        hashes, _, _, before = words_of(data, offsets)
        at = np.arange(max(len(hashes) - gram + 1, 0))
        return hashes, textbytes.RangeHash(hashes).of(at, at + gram), before

    return of


def _cut(data, offsets, text, starts, sizes):
    hashes, _, _, before = words_of(data, offsets)
    pieces = textbytes.gather(hashes.view(np.int64), before[text] + starts, sizes)
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(pieces))


def _compare(window):
    def compare(batch):
        lists = batch.column(7)
        words = lists.flatten().to_numpy()
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        # Words as numbers from 2; 1 parts the regions.
        distinct = np.unique(words)
        numbers = np.searchsorted(distinct, words) + 2
        region = np.repeat(np.arange(len(sizes)), sizes)
        text = np.ones(len(words) + len(sizes), np.int64)
        text[np.arange(len(words)) + region] = numbers
        begins = np.cumsum(sizes) - sizes + np.arange(len(sizes))
        index = FMIndex(text, len(distinct) + 2)
        done = batch.column(8).to_numpy(zero_copy_only=False)
        asked = np.flatnonzero(~done)
        row, start, size = index.repeated_windows(begins[asked], sizes[asked], window)
        row = asked[row]
        out = [_rows(batch, row, start, size)]
        shards = batch.column(1).to_numpy()
        if (shards > 1).any():
            out.append(_window_rows(batch, words, sizes, np.flatnonzero(shards > 1), window))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(
            x.num_rows for x in out) else None

    return compare


def _rows(batch, row, start, size, high=None, low=None, done=None):
    nothing = pa.nulls(len(row), pa.int64())
    place = batch.column(5).to_numpy()[row] + start
    return pa.RecordBatch.from_arrays(
        [
            batch.column(3).take(pa.array(row)),
            batch.column(4).take(pa.array(row)),
            pa.array(place.astype(np.int32)),
            pa.array(size.astype(np.int32)),
            nothing if high is None else pa.array(high),
            nothing if low is None else pa.array(low),
            pa.nulls(len(row), pa.bool_()) if done is None else pa.array(done),
        ],
        ["key", "variant", "start", "size", "high", "low", "done"],
    )


def _window_rows(batch, words, sizes, rows, window):
    """All windows of the regions of anchors with several shards, by hash."""
    n = sizes[rows] - window + 1
    row = np.repeat(rows, n)
    start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(sizes) - sizes)[row] + start
    hashes = [
        textbytes.RangeHash(words.view(np.uint64), kind).of(at, at + window).view(np.int64)
        for kind in (0, 1)
    ]
    done = batch.column(8).to_numpy(zero_copy_only=False)[row]
    return _rows(batch, row, start, np.full(len(row), window), *hashes, done)


def repeated_stretches(docs, window=WINDOW, gram=GRAM):
    """Stretches of words, of documents as of `keyed`, that windows found elsewhere cover."""
    found = anchors.found_regions(docs, _symbols(gram), window, gram, keep_first=False)
    settled = stored(anchors.settled_regions(found, keep_first=False), "words-settled")
    cut = anchors.cut_out(settled, docs, _cut, "array<long>")
    compared = stored(
        anchors.compared_in_blocks(cut, _compare(window), _COMPARED, BLOCK_WORDS), "words-compared"
    )
    names = ["key", "variant", "start", "size"]
    everywhere = Window.partitionBy("high", "low")
    several = (
        compared.filter("high IS NOT NULL")
        .withColumn("n", F.count(F.lit(1)).over(everywhere))
        .filter("n > 1 AND NOT done")
    )
    return (
        settled.filter("covered")
        .select(names)
        .unionByName(compared.filter("high IS NULL").select(names))
        .unionByName(several.select(names))
    )


def remove_repeats(docs, id_col="doc_id", text_col="text", window=WINDOW):
    """Per row: doc_id, n_words, n_removed, kept_sha256 and the removed ranges of words.

    Words are stretches without ASCII white space, unchanged; null texts have none. Each word
    covered by `window` consecutive words that also start anywhere else, in the same document or
    another, is removed; kept words are joined by one blank before they are hashed. Rows that
    repeat an id with another text and rows without id are documents of their own; a row repeated
    whole is one document and not a copy of itself.
    """
    named = keyed(docs, id_col, text_col)
    covered = repeated_stretches(named, window)
    rows = with_stretches(named, covered).select("doc_id", "text", "stretches")

    def digest(batches):
        schema = pa.schema(
            [
                ("doc_id", pa.int64()),
                ("n_words", pa.int64()),
                ("n_removed", pa.int64()),
                ("kept_sha256", pa.string()),
                ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ]
        )
        held = []
        for part, i, data, starts, sizes in _texts_and_stretches(batches, 1, 2):
            begins, ends, _ = textbytes.runs(~textbytes.SPACE[data], np.array([0, len(data)]))
            gone = anchors.covered_positions(len(begins), starts, sizes)
            edges = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
            held.append(
                {
                    "doc_id": part.column(0)[i].as_py(),
                    "n_words": len(begins),
                    "n_removed": int(gone.sum()),
                    "kept_sha256": hashlib.sha256(_joined(data, begins[~gone], ends[~gone])).hexdigest(),
                    "removed": [
                        {"start": int(a), "end": int(b)}
                        for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True)
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
        "doc_id long, n_words long, n_removed long, kept_sha256 string, "
        "removed array<struct<start: long, end: long>>",
    )


def _joined(data, begins, ends):
    """The bytes of some words, joined by one blank."""
    if not len(begins):
        return b""
    sizes = ends - begins + 1
    spaced = np.append(data, np.uint8(0x20))
    index = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    # The byte after a word becomes the blank.
    index[np.cumsum(sizes) - 1] = len(data)
    return spaced[index[:-1]].tobytes()
