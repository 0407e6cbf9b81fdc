"""A Katz backoff model of word pairs, learned from and applied to whole corpora.

Counts, look-ups and sums go between two kinds of tasks. Chunks hold some documents; ranges hold
the n-grams with some hashes. What they exchange are packed arrays, shuffled by Spark:

1. each chunk sends its distinct words and pairs, with how often they occur in training texts, to
   their ranges, 
2. each range adds up, stores the totals, partitioned by order and range, and answers each chunk,
3. with the totals a chunk scores its tokens but for the backoff weights; it sends, to the ranges
   of contexts, what it holds of the weights' sums and which documents need which weight,
4. ranges of contexts finish the weights and send back their logarithms, summed by document.

P(w | h) = d(r) r / (c(h) + 1) for pairs met r times in training, once included, and a(h) P(w)
for others. d is Good and Turing's discount for r up to K; the one count more is kept for pairs that
were never met. a(h) is the mass left divided by the mass of P that the met pairs leave, so that
every context sums to 1 exactly. P(w) = d(c) c / N; what that leaves goes to one word that stands
for all unknown ones. A text begins in a context of its own and ends with an end token.
"""

import hashlib

import numpy as np
import pyarrow as pa
from marketlens.llm import textbytes
from marketlens.llm.runtime import ship, stored
from marketlens.llm.textbytes import RangeHash, mixed
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

#: Pairs met less often in training count as never met: 1, every pair that was met is kept.
MIN_PAIR = 1
#: Counts up to this are discounted.
K = 5
CHUNK_WORDS = 500_000
#: Bytes of text hashed at a time, which takes about 50 bytes of memory for each.
SLICE_BYTES = 1 << 20
#: Bytes of text per range of n-grams, and per range of contexts.
RANGE_BYTES = 12 << 20
CONTEXT_BYTES = 24 << 20

_U = np.uint64
END, START = _U(0x243F6A8885A308D3), _U(0x13198A2E03707344)
_WORDS, _PAIRS, _STREAM, _DOCS, _CONTEXTS, _WEIGHTS = range(6)


def packed(sorted_keys):
    """Sorted numbers as bytes that compress well: planes of their differences."""
    steps = np.diff(sorted_keys, prepend=_U(0)) if len(sorted_keys) else sorted_keys
    return planes(steps)


def unpacked(data):
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


def planes(numbers):
    """An array's bytes, all lowest ones first, then all second ones, and so on."""
    width = numbers.dtype.itemsize
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, width).T).tobytes()


def from_planes(data, dtype):
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def range_bounds(sorted_keys, n):
    """Where in sorted 64-bit keys each of n equal ranges of hashes begins, with the end."""
    edges = [_U((i * 2**64) // n) for i in range(1, n)]
    inner = np.searchsorted(sorted_keys, np.array(edges, np.uint64)) if n > 1 else np.empty(0, int)
    return np.concatenate(([0], inner, [len(sorted_keys)])).astype(np.int64)


class Chunk:
    """The tokens of some documents; read again in the same order, they give the same chunk."""

    def __init__(self, place, doc_ids, train, words, sizes):
        self.doc_ids, self.train, self.sizes = doc_ids, train, sizes + 1
        ends = np.cumsum(sizes)
        tokens = np.insert(words, ends, END)
        self.distinct, self.token = np.unique(tokens, return_inverse=True)
        digest = hashlib.sha256()
        digest.update(repr((place, doc_ids)).encode())
        for part in (train, sizes, words):
            digest.update(np.ascontiguousarray(part).tobytes())
        self.name = int.from_bytes(digest.digest()[:8], "little", signed=True)


def chunks(batches):
    """Chunks of about CHUNK_WORDS words, or a single longer text, of rows (doc_id, train, text)."""
    from pyspark import TaskContext

    doc_ids, train, words, sizes, held, n = [], [], [], [], 0, 0

    def done():
        place = (TaskContext.get().partitionId(), n)
        return Chunk(place, doc_ids, np.concatenate(train), np.concatenate(words), np.concatenate(sizes))

    for part in textbytes.slices(batches, 2, SLICE_BYTES):
        data, offsets = textbytes.flat(part.column(2))
        starts, ends, text = textbytes.runs(~textbytes.SPACE[data], offsets)
        doc_ids += part.column(0).to_pylist()
        train.append(part.column(1).to_numpy(zero_copy_only=False).astype(bool))
        lower = textbytes.LOWER[data]
        words.append(RangeHash(lower).of(starts, ends))
        sizes.append(np.bincount(text, minlength=part.num_rows))
        held += len(starts)
        if held >= CHUNK_WORDS:
            yield done()
            doc_ids, train, words, sizes, held, n = [], [], [], [], 0, n + 1
    if doc_ids:
        yield done()


def pair_keys(distinct, token, sizes):
    """A hash per token, of it and the one before; a document's first token follows START."""
    own = distinct[token]
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[np.cumsum(sizes) - sizes] = START
    return mixed(before * _U(0x9E3779B97F4A7C15) + mixed(own + _U(0xB5297A4D3F84D5B5)))


def _schema(**kinds):
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "longs": pa.list_(pa.int64())}
    return pa.schema([(name, types[kind]) for name, kind in kinds.items()])


# The first column is the one that the rows are grouped by where they go.
_COUNTED = _schema(range="int", chunk="long", kind="int", keys="binary", counts="binary")
_TOTALS = _schema(chunk="long", range="int", answers="binary", sums="longs", kind="int")
_CHUNKED = _schema(chunk="long", kind="int", range="int", a="binary", b="binary", ids="longs")
_MOVED = _schema(
    range="int", chunk="long", kind="int", a="binary", b="binary", c="binary", d="binary", ids="longs"
)
_SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _batch(schema, rows):
    return pa.RecordBatch.from_pylist(rows, schema)


def _lean(function):
    """The function, in a worker that keeps little from the task before and for the next one."""

    def lean(batches):
        textbytes.give_back()
        yield from function(batches)
        textbytes.give_back()

    return lean


def _mapped(df, function, schema):
    return df.mapInArrow(_lean(function), schema if isinstance(schema, str) else from_arrow_schema(schema))


def _count(n_ranges):
    def count(batches):
        for chunk in chunks(batches):
            in_train = np.repeat(chunk.train, chunk.sizes)
            word_counts = np.bincount(chunk.token[in_train], minlength=len(chunk.distinct))
            pairs = pair_keys(chunk.distinct, chunk.token, chunk.sizes)
            distinct = np.unique(pairs)
            trained = np.sort(pairs[in_train])
            counts = np.searchsorted(trained, distinct, "right") - np.searchsorted(trained, distinct)
            for kind, keys, n in ((_WORDS, chunk.distinct, word_counts), (_PAIRS, distinct, counts)):
                bounds = range_bounds(keys, n_ranges)
                rows = [
                    {
                        "range": i,
                        "chunk": chunk.name,
                        "kind": kind,
                        "keys": packed(keys[a:b]),
                        "counts": planes(n[a:b].astype(np.uint32)),
                    }
                    for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))
                    if b > a
                ]
                yield _batch(_COUNTED, rows)

    return count


def _grouped(batches):
    """Rows as tuples, group after group, of batches sorted by their first column."""
    held, current = [], None
    for batch in batches:
        columns = batch.columns
        for i in range(batch.num_rows):
            row = tuple(c[i].as_py() for c in columns)
            if held and row[0] != current:
                yield current, held
                held = []
            current = row[0]
            held.append(row)
    if held:
        yield current, held


def _total(batches):
    """Add up what the chunks have sent to a range, and answer each of them.

    An answer is twice the total, plus 1 for the one chunk that has to add the n-gram to sums.
    """
    for number, rows in _grouped(batches):
        for kind in (_WORDS, _PAIRS):
            own = [r for r in rows if r[2] == kind]
            if not own:
                continue
            parts = [unpacked(r[3]) for r in own]
            keys = np.concatenate(parts)
            counts = np.concatenate([from_planes(r[4], np.uint32) for r in own]).astype(np.int64)
            order = np.argsort(keys, kind="stable")
            ranked = keys[order]
            new = np.ones(len(keys), bool)
            new[1:] = ranked[1:] != ranked[:-1]
            totals = np.add.reduceat(counts[order], np.flatnonzero(new))
            answers = np.empty(len(keys), np.uint64)
            answers[order] = 2 * totals[np.cumsum(new) - 1] + new
            at = 0
            for r, part in zip(own, parts, strict=True):
                answer = planes(answers[at : at + len(part)])
                yield _batch(_TOTALS, [{"chunk": r[1], "range": number, "answers": answer, "kind": kind}])
                at += len(part)
            # How many n-grams were met 0, 1, ..., K + 1 times; all tokens; all n-grams met.
            sums = np.bincount(np.minimum(totals, K + 2), minlength=K + 3)[: K + 2].tolist()
            sums += [int(totals.sum()), int((totals > 0).sum())]
            yield _batch(_TOTALS, [{"range": number, "sums": sums, "kind": kind}])


def discounts(met, k=K):
    """Good-Turing discounts for counts 0 to k + 1 (and above: 1), from how many n-grams were met
    0, 1, ..., k + 1 times. A count whose estimate is no discount keeps its value."""
    d = np.ones(k + 2)
    if len(met) > k + 1 and met[1] > 0:
        common = (k + 1) * met[k + 1] / met[1]
        for r in range(1, k + 1):
            if met[r] > 0 and common < 1:
                ratio = ((r + 1) * met[r + 1] / (r * met[r]) - common) / (1 - common)
                if 0 < ratio < 1:
                    d[r] = ratio
    return d


class Model:
    """What scoring needs besides the counts of a chunk's own n-grams."""

    def __init__(self, word_sums, pair_sums):
        met, self.n_tokens, self.n_words = word_sums[: K + 2], word_sums[-2], word_sums[-1]
        self.word_discount, self.pair_discount = discounts(met), discounts(pair_sums[: K + 2])
        if self.n_tokens and (self.word_discount == 1).all():
            self.word_discount[1] = 0.5  # something has to be left for unknown words
        taken = sum((1 - self.word_discount[r]) * r * met[r] for r in range(1, K + 1))
        if self.n_tokens and taken <= 0:
            # No word was met 1 to K times: one token's worth is taken from all.
            self.share, self.unknown = 1 / (self.n_tokens + 1), 1 / (self.n_tokens + 1)
        else:
            self.share = 1 / self.n_tokens if self.n_tokens else 0.0
            self.unknown = taken / self.n_tokens if self.n_tokens else 1.0

    def word(self, counts):
        p = self.word_discount[np.minimum(counts, K + 1)] * counts * self.share
        return np.where(counts > 0, p, self.unknown)

    def pair(self, counts):
        """Discounted counts of pairs, 0 for those that count as never met."""
        kept = self.pair_discount[np.minimum(counts, K + 1)] * counts
        return np.where(counts >= MIN_PAIR, kept, 0.0)

    def base(self, counts):
        return np.log10((counts + 1) / (self.n_tokens + self.n_words + 1))


def _stream(batches):
    """Chunks as rows: distinct words, tokens as numbers of these, documents."""
    for chunk in chunks(batches):
        yield _batch(
            _CHUNKED,
            [
                {
                    "chunk": chunk.name,
                    "kind": _STREAM,
                    "range": 0,
                    "a": packed(chunk.distinct),
                    "b": planes(chunk.token.astype(np.uint32)) + planes(chunk.sizes.astype(np.uint32)),
                    "ids": chunk.doc_ids,
                }
            ],
        )


def _score(model, n_ranges):
    """Score chunks but for the backoff weights; send on what these need."""

    def score(batches):
        for name, rows in _grouped(batches):
            streams = [r for r in rows if r[1] == _STREAM]
            answers = {
                kind: np.concatenate([from_planes(r[3], np.uint64) for r in rows if r[1] == kind] or [np.empty(0, _U)])
                for kind in (_WORDS, _PAIRS)
            }
            if len(streams) != 1:
                raise RuntimeError("The documents weren't read in the same order twice.")
            yield from _score_chunk(model, n_ranges, name, streams[0], answers)

    return score


def _score_chunk(model, n_ranges, name, stream, answers):
    distinct, doc_ids = unpacked(stream[3]), stream[5]
    n_docs = len(doc_ids)
    sizes = from_planes(stream[4][len(stream[4]) - 4 * n_docs :], np.uint32).astype(np.int64)
    token = from_planes(stream[4][: len(stream[4]) - 4 * n_docs], np.uint32).astype(np.int64)
    if len(answers[_WORDS]) != len(distinct):
        raise RuntimeError("The documents weren't read in the same order twice.")
    word_counts = (answers[_WORDS] >> _U(1)).astype(np.int64)
    doc = np.repeat(np.arange(n_docs), sizes)
    pairs = pair_keys(distinct, token, sizes)
    pair_distinct = np.unique(pairs)
    at_pair = np.searchsorted(pair_distinct, pairs)
    pair_counts = (answers[_PAIRS] >> _U(1)).astype(np.int64)
    owned = (answers[_PAIRS] & _U(1)).astype(bool)
    if len(pair_counts) != len(pair_distinct):
        raise RuntimeError("The documents weren't read in the same order twice.")
    # Contexts: the chunk's words, and START as one more; how often it was a context.
    start = len(distinct)
    end_at = np.searchsorted(distinct, END)
    context_counts = np.append(word_counts, word_counts[end_at])
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[np.cumsum(sizes) - sizes] = start
    counts = word_counts[token]
    p_word = model.word(counts)
    kept = model.pair(pair_counts)[at_pair]
    met = kept > 0
    part = np.where(met, np.log10(np.where(met, kept, 1.0) / (context_counts[context] + 1)), np.log10(p_word))
    sums = [
        sizes.astype(np.float64),
        np.bincount(doc, counts > 0, n_docs),
        np.bincount(doc, model.base(counts), n_docs),
        np.bincount(doc, part, n_docs),
    ]
    yield _batch(
        _MOVED,
        [{"range": abs(name) % n_ranges, "chunk": name, "kind": _DOCS,
          "a": np.concatenate(sums).tobytes(), "ids": doc_ids}],
    )
    # Sums of the contexts, from one token of each pair that this chunk has to add.
    example = np.empty(len(pair_distinct), np.int64)
    example[at_pair] = np.arange(len(token))
    adds = np.flatnonzero(owned & (pair_counts >= MIN_PAIR))
    of = example[adds]
    taken = np.bincount(context[of], kept[of], start + 1)
    covered = np.bincount(context[of], p_word[of], start + 1)
    # Contexts that were never met have no pairs: their weight is 1.
    asks = np.flatnonzero(~met & (context_counts[context] >= MIN_PAIR))
    keys = np.append(distinct, START)
    needed = np.zeros(start + 1, bool)
    needed[context[asks]] = True
    needed[context[of]] = True
    which = np.flatnonzero(needed)
    which = which[np.argsort(keys[which])]
    number = np.full(start + 1, -1)
    number[which] = np.arange(len(which))
    asked = number[context[asks]]
    order = np.lexsort((doc[asks], asked))
    asked, asking = asked[order], doc[asks][order]
    bounds = range_bounds(keys[which], n_ranges)
    rows = []
    for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        if a == b:
            continue
        low, high = np.searchsorted(asked, (a, b))
        own = which[a:b]
        sent = np.flatnonzero(taken[own] > 0)
        rows.append(
            {
                "range": i,
                "chunk": name,
                "kind": _CONTEXTS,
                "a": packed(keys[own]),
                "b": planes(context_counts[own].astype(np.uint32))
                + planes(np.bincount(asked[low:high] - a, minlength=b - a).astype(np.uint32)),
                "c": planes(sent.astype(np.uint32)) + taken[own][sent].tobytes() + covered[own][sent].tobytes(),
                "d": planes(asking[low:high].astype(np.uint32)),
                "ids": [n_docs],
            }
        )
    for row in rows:
        yield _batch(_MOVED, [row])


def _weigh(batches):
    """Backoff weights of a range of contexts; their logarithms, added up by document."""
    for number, rows in _grouped(batches):
        for r in rows:
            if r[2] == _DOCS:
                yield _batch(_MOVED, [{"range": number, "chunk": r[1], "kind": _DOCS, "a": r[3], "ids": r[7]}])
        own = [r for r in rows if r[2] == _CONTEXTS]
        if not own:
            continue
        parts = [unpacked(r[3]) for r in own]
        keys = np.concatenate(parts)
        begins = np.cumsum([0] + [len(x) for x in parts])
        distinct, at = np.unique(keys, return_inverse=True)
        counts = np.zeros(len(distinct))
        taken, covered = np.zeros(len(distinct)), np.zeros(len(distinct))
        asked = []
        for r, a, b in zip(own, begins, begins[1:], strict=False):
            n = b - a
            counts[at[a:b]] = from_planes(r[4][: 4 * n], np.uint32)
            asked.append(from_planes(r[4][4 * n :], np.uint32).astype(np.int64))
            n_sent = len(r[5]) // 20
            sent = from_planes(r[5][: 4 * n_sent], np.uint32).astype(np.int64)
            np.add.at(taken, at[a:b][sent], np.frombuffer(r[5][4 * n_sent : 12 * n_sent]))
            np.add.at(covered, at[a:b][sent], np.frombuffer(r[5][12 * n_sent :]))
        weights = np.log10((1 - taken / (counts + 1)) / (1 - covered))
        for r, a, b, n_asked in zip(own, begins, begins[1:], asked, strict=False):
            docs = from_planes(r[6], np.uint32).astype(np.int64)
            sums = np.bincount(docs, np.repeat(weights[at[a:b]], n_asked), r[7][0])
            yield _batch(_MOVED, [{"range": number, "chunk": r[1], "kind": _WEIGHTS, "a": sums.tobytes()}])


def _finish(batches):
    for _, rows in _grouped(batches):
        docs = [r for r in rows if r[1] == _DOCS]
        weights = [np.frombuffer(r[3]) for r in rows if r[1] == _WEIGHTS]
        for r in docs:
            n = len(r[4])
            sizes, known, base, part = np.frombuffer(r[3]).reshape(4, n)
            total = np.sum(weights, axis=0) if weights else 0.0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(r[4], pa.int64()),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(known.astype(np.int64)),
                    pa.array(base),
                    pa.array(part + total),
                ],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )


def scores(docs, train, id_col="doc_id", text_col="text", reread=False):
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score and score.

    `train`: a boolean column; where it is true, the model learns from the row. Words are
    lower-cased stretches without ASCII white space, an end token follows; null and empty texts
    are an end token. n_known: tokens met in training; train_tokens: all tokens in training;
    base_score: add-one unigrams; score: the model's log10 probability. Rows count as often as
    they are there; without training rows, words are all unknown and have probability 1.

    The documents are read twice and must come in the same order: `reread` says that they are
    files that can be read again as they are; otherwise they are stored first.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(train, F.lit(False)).alias("train"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    if not reread:
        rows = stored(rows, "katz-documents")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_ranges, n_contexts = 1 + size // RANGE_BYTES, 1 + size // CONTEXT_BYTES
    counted = _mapped(rows, _count(n_ranges), _COUNTED)
    ranges = counted.repartition(n_ranges, "range").sortWithinPartitions("range")
    totals = stored(_mapped(ranges, _total, _TOTALS), "katz-totals")
    sums = (
        totals.filter("sums IS NOT NULL")
        .select("kind", F.posexplode("sums"))
        .groupBy("kind", "pos")
        .agg(F.sum("col").alias("n"))
    )
    by_kind = {_WORDS: [0] * (K + 4), _PAIRS: [0] * (K + 4)}
    for r in sums.collect():  # two kinds, K + 4 sums each
        by_kind[r.kind][r.pos] = r.n
    model = Model(by_kind[_WORDS], by_kind[_PAIRS])
    nothing = F.lit(None)
    answers = totals.filter("answers IS NOT NULL").select(
        "chunk", "kind", "range", F.col("answers").alias("a"), nothing.cast("binary").alias("b"),
        nothing.cast("array<long>").alias("ids"),
    )
    streams = _mapped(rows, _stream, _CHUNKED)
    chunked = streams.unionByName(answers).repartition("chunk").sortWithinPartitions("chunk", "kind", "range")
    moved = _mapped(chunked, _score(model, n_contexts), _MOVED)
    contexts = moved.repartition(n_contexts, "range").sortWithinPartitions("range")
    weighed = _mapped(contexts, _weigh, _MOVED)
    back = weighed.select("chunk", "kind", "range", "a", "ids").repartition("chunk")
    scored = _mapped(back.sortWithinPartitions("chunk", "kind", "range"), _finish, _SCORED)
    return scored.withColumn("train_tokens", F.lit(model.n_tokens).cast("long"))
