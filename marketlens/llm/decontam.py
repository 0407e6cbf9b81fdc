"""Benchmark decontamination: one Aho-Corasick automaton over windows of normalised items.

A text is normalised as one byte array (lower case, words parted by single blanks) together with
the word number of every byte, scanned once, and matches are mapped back to words and to bytes of
the original text.
"""

import hashlib

import numpy as np
import pyarrow as pa
from marketlens.llm import textbytes
from marketlens.llm.runtime import ship
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 10
#: Items go to the workers in blocks of about so many bytes; every text meets every block.
BLOCK_BYTES = 8 << 20
SLICE_BYTES = 4 << 20

_BLANK, _BREAK = 0x20, 0x0A

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField(
            "spans",
            T.ArrayType(
                T.StructType(
                    [T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
                )
            ),
        ),
    ]
)


class Normalised:
    """The words of some texts: for scanning, and where they are in the original bytes."""

    def __init__(self, data, offsets):
        lower = textbytes.LOWER[data]
        letter = textbytes.LETTER[lower]
        self.starts, self.ends, self.text = textbytes.runs(letter, offsets)
        self.n_texts = len(offsets) - 1
        self.words_before = np.searchsorted(self.text, np.arange(self.n_texts + 1))
        # Each word with a blank before it; a blank and a line break end each text.
        sizes = self.ends - self.starts + 1
        at = np.cumsum(sizes) - sizes + 2 * self.text
        total = int(sizes.sum()) + 2 * self.n_texts
        self.line = np.full(total, _BLANK, np.uint8)
        words_end = np.concatenate(([0], np.cumsum(sizes)))[self.words_before[1:]]
        self.line[words_end + 2 * np.arange(1, self.n_texts + 1) - 1] = _BREAK
        into = np.repeat(at + 1 - self.starts, sizes - 1)
        source = np.flatnonzero(letter)
        self.line[into + source] = lower[source]
        self.word_at = at

    def haystack(self):
        return self.line.tobytes().decode("latin-1")

    def words_of(self, text):
        low, high = self.words_before[text], self.words_before[text + 1]
        return [self.line[a + 1 : a + 1 + n].tobytes() for a, n in zip(
            self.word_at[low:high], (self.ends - self.starts)[low:high], strict=True)]


def item_windows(items, window=WINDOW):
    """{window as scanned: ids of its items}; an item of fewer words, but not none, is one window.

    `items`: (id, text or null) pairs; items that repeat an id count as one item.
    """
    texts = pa.array([text or "" for _, text in items], pa.string())
    normalised, found = Normalised(*textbytes.flat(texts)), {}
    for i, (item_id, _) in enumerate(items):
        words = normalised.words_of(i)
        for j in range(max(len(words) - window, 0) + 1 if words else 0):
            part = words[j : j + window]
            key = (b" " + b" ".join(part) + b" ").decode("latin-1")
            found.setdefault(key, (len(part), set()))[1].add(str(item_id))
    return found


def _automaton(windows):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for key, (n_words, items) in windows.items():
        automaton.add_word(key, (n_words, sorted(items)))
    automaton.make_automaton()
    return automaton


_built = {}


def _of_block(block):
    """The automaton of a broadcast block; a worker keeps the last one, by the items' digest."""
    digest, rows, window = block.value
    if digest not in _built:
        _built.clear()
        _built[digest] = _automaton(item_windows(rows, window))
    return _built[digest]


def _scan(data, offsets, automata):
    normalised = Normalised(data, offsets)
    n_words = len(normalised.starts)
    depth = np.zeros(n_words + 1, np.int32)
    items_of = {}
    haystack = normalised.haystack()
    for automaton in automata:
        if not len(automaton):
            continue
        ends, sizes, values = [], [], []
        for end, (size, items) in automaton.iter(haystack):
            ends.append(end)
            sizes.append(size)
            values.append(items)
        if not ends:
            continue
        # A match ends on the blank after its last word.
        last = np.searchsorted(normalised.word_at, np.array(ends), "left") - 1
        first = last + 1 - np.array(sizes)
        np.add.at(depth, first, 1)
        np.add.at(depth, last + 1, -1)
        for text, items in zip(normalised.text[last].tolist(), values, strict=True):
            items_of.setdefault(text, set()).update(items)
    hit = np.cumsum(depth[:-1]) > 0
    counts = np.bincount(normalised.text, hit, normalised.n_texts).astype(int)
    words = np.diff(normalised.words_before)
    nothing = hashlib.sha256(b"").hexdigest()
    for i in range(normalised.n_texts):
        spans, digest, n_items = [], nothing, 0
        if counts[i]:
            low, high = normalised.words_before[i], normalised.words_before[i + 1]
            edges = np.diff(np.concatenate(([0], hit[low:high].astype(np.int8), [0])))
            begin = normalised.starts[low + np.flatnonzero(edges == 1)] - offsets[i]
            end = normalised.ends[low + np.flatnonzero(edges == -1) - 1] - offsets[i]
            spans = [{"start": int(a), "end": int(b)} for a, b in zip(begin, end, strict=True)]
            n_items = len(items_of[i])
            digest = hashlib.sha256(",".join(sorted(items_of[i])).encode()).hexdigest()
        yield {
            "n_words": int(words[i]),
            "n_hit": int(counts[i]),
            "n_items": n_items,
            "items_sha256": digest,
            "contaminated": bool(counts[i]),
            "spans": spans,
        }


def item_blocks(spark, benchmark, id_col="item_id", text_col="text", window=WINDOW):
    """The items as broadcast blocks of about BLOCK_BYTES, each collected on its own."""
    items = benchmark.select(
        F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")
    ).filter("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // BLOCK_BYTES
    blocks = []
    for i in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        rows = [(row.item_id, row.text) for row in part.collect()]
        digest = hashlib.sha256(repr((rows, window)).encode()).hexdigest()
        blocks.append(spark.sparkContext.broadcast((digest, rows, window)))
    return blocks


def contamination(docs, benchmark, window=WINDOW, text_col="text", prefix=""):
    """All columns of `docs` and, under `prefix`, what of each text occurs in `benchmark`.

    n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256,
    contaminated, and spans: the hit stretches as byte ranges of the original text. Null and
    empty texts have no words; a row is judged on its own, so repeated rows and ids are fine.
    An existing column named like a result is replaced. The benchmark is a stated query set: it
    goes to the workers in blocks, and no text is shuffled.
    """
    spark = docs.sparkSession
    ship(spark)
    blocks = item_blocks(spark, benchmark, window=window)
    names = [prefix + f.name for f in HITS.fields]
    kept = docs.select([c for c in docs.columns if c not in names])
    column = kept.columns.index(text_col)
    all_names = kept.columns + names
    schema = T.StructType(
        kept.schema.fields + [T.StructField(prefix + f.name, f.dataType) for f in HITS.fields]
    )

    def scan(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        result = to_arrow_schema(HITS)
        for part in textbytes.slices(batches, column, SLICE_BYTES):
            automata = (_of_block(block) for block in blocks)
            rows = list(_scan(*textbytes.flat(part.column(column)), automata))
            found = pa.RecordBatch.from_pylist(rows, result)
            yield pa.RecordBatch.from_arrays(part.columns + found.columns, all_names)

    return kept.mapInArrow(scan, schema)
