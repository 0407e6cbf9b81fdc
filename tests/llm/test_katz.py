import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from marketlens.llm import katz, textbytes
from marketlens.llm.katz import discounts, packed, planes, from_planes, range_bounds, scores, unpacked
from pyspark.sql import functions as F

from tests.llm.tools import corpus, frame, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), None]


class Brute:
    """The model written down one n-gram at a time."""

    def __init__(self, texts):
        self.words, self.pairs, self.contexts = Counter(), Counter(), Counter()
        for text in texts:
            own = tokens(text)
            self.words.update(own)
            before = ["<start>", *own[:-1]]
            self.pairs.update(zip(before, own, strict=True))
            self.contexts.update(before)
        self.n, self.v = sum(self.words.values()), len(self.words)
        met = [Counter(c.values()) for c in (self.words, self.pairs)]
        self.d = [discounts([m[r] for r in range(katz.K + 2)]) for m in met]
        if (self.d[0] == 1).all():
            self.d[0][1] = 0.5
        taken = sum((1 - self.d[0][min(c, katz.K + 1)]) * c for c in self.words.values())
        self.share = 1 / self.n if taken > 0 else 1 / (self.n + 1)
        self.unknown = taken / self.n if taken > 0 else 1 / (self.n + 1)
        self.kept = defaultdict(dict)
        for (h, w), r in self.pairs.items():
            if r >= katz.MIN_PAIR:
                self.kept[h][w] = self.d[1][min(r, katz.K + 1)] * r / (self.contexts[h] + 1)

    def word(self, w):
        c = self.words[w]
        return self.d[0][min(c, katz.K + 1)] * c * self.share if c else self.unknown

    def p(self, h, w):
        own = self.kept.get(h, {})
        if w in own:
            return own[w]
        return (1 - sum(own.values())) / (1 - sum(map(self.word, own))) * self.word(w)

    def score(self, text):
        own = tokens(text)
        known = sum(w in self.words for w in own)
        base = sum(math.log10((self.words[w] + 1) / (self.n + self.v + 1)) for w in own)
        before = ["<start>", *own[:-1]]
        full = sum(math.log10(self.p(h, w)) for h, w in zip(before, own, strict=True))
        return len(own), known, self.n, base, full


def compare(spark, rows, parts=4):
    held = [i for i, _ in rows if i is not None and i % 7 == 2]
    model = Brute([t for i, t in rows if i not in held])
    found = scores(frame(spark, rows, parts=parts), ~F.col("doc_id").isin(held or [-1])).collect()
    assert len(found) == len(rows)
    by_id = defaultdict(list)
    for r in found:
        by_id[r.doc_id].append((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
    for doc_id, text in rows:
        expected = model.score(text)
        assert any(
            mine[:3] == expected[:3] and np.allclose(mine[3:], expected[3:], rtol=1e-9, atol=1e-9)
            for mine in by_id[doc_id]
        ), (doc_id, by_id[doc_id], expected)
    return model


def test_equals_brute_force(spark):
    model = compare(spark, corpus(90, 3))
    assert any(model.d[1][2:] < 1) or any(model.d[0] < 1)
    for h in [*list(model.kept)[:40], "<start>", "never met"]:
        total = sum(model.p(h, w) for w in model.words) + model.p(h, "unknown word")
        assert abs(total - 1) < 1e-9


def test_many_chunks_and_ranges(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, words(rng, 5) + " kalo kalos " * 40 + words(rng, 30)) for i in range(60)]
    monkeypatch.setattr(katz, "RANGE_BYTES", 3000)
    monkeypatch.setattr(katz, "CONTEXT_BYTES", 9000)
    compare(spark, rows, parts=7)


def test_odd_rows(spark):
    compare(spark, [(1, "a b"), (2, "c c c"), (3, None), (4, ""), (5, "A b"), (1, "a b")])
    df = frame(spark, [(2, "x y"), (9, "z")], "doc_id long, text string")
    rows = scores(df, F.lit(False)).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.score) for r in rows} == {(2, 3, 0, 0, 0.0), (9, 2, 0, 0, 0.0)}
    assert scores(df.limit(0), F.lit(True)).collect() == []
    named = spark.createDataFrame([(None, "a b", 1)], "doc_id long, text string, range int")
    (row,) = scores(named, F.lit(None).cast("boolean")).collect()
    assert row.doc_id is None and row.train_tokens == 0


def test_discounts_take_off_what_good_and_turing_say():
    met = [0, 100, 40, 20, 12, 8, 5]
    d = discounts(met)
    common = 6 * 5 / 100
    assert d[1] == pytest.approx((2 * 40 / 100 - common) / (1 - common)) and d[6] == 1
    assert (discounts([0] * 7) == 1).all()


def test_packing_of_numbers():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, np.uint64))
    assert (unpacked(packed(keys)) == keys).all() and len(unpacked(packed(keys[:0]))) == 0
    assert (from_planes(planes(keys), np.uint64) == keys).all()
    bounds = range_bounds(keys, 7)
    assert bounds[0] == 0 and bounds[-1] == 1000 and (np.diff(bounds) > 0).all()


def test_pairs_met_once_keep_their_own_probability(spark):
    # Pairs met once, twice, ... in training: r = 1 has a discount below 1.
    rows = [(i, f"p{i} q{i} " * (1 + i % 4)) for i in range(1, 40)] + [(100, "p4 q4 p9 q9"), (101, "q4 p9")]
    found = {r.doc_id: r for r in scores(frame(spark, rows), F.col("doc_id") < 100).collect()}
    own = [tokens(t) for i, t in rows if i < 100]
    pairs, contexts = Counter(), Counter()
    for words_of_text in own:
        before = ["<start>", *words_of_text[:-1]]
        pairs.update(zip(before, words_of_text, strict=True))
        contexts.update(before)
    met = Counter(pairs.values())
    d = discounts([met[r] for r in range(katz.K + 2)])
    assert pairs["p4", "q4"] == 1 and pairs["<start>", "p4"] == 1 and pairs["q4", None] == 1 and d[1] < 1
    chain = ["<start>", "p4", "q4", None]
    score = sum(
        math.log10(d[1] / (contexts[h] + 1)) for h, w in zip(chain, chain[1:], strict=False)
    )
    assert found[4].score == pytest.approx(score, abs=1e-9)


def test_a_chunk_takes_little_memory_beside_its_texts(monkeypatch):
    rng = random.Random(6)
    vocabulary = words(rng, 2000).split()
    texts = [" ".join(rng.choices(vocabulary, k=1000)) for _ in range(2500)]
    size = sum(map(len, texts))
    assert size > 2 * (4 << 20)
    batch = pa.record_batch([range(2500), [True] * 2500, texts], ["doc_id", "train", "text"])
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 0))
    ones = np.ones(1, np.uint64)
    monkeypatch.setattr(textbytes, "_powers", [ones, ones])
    tracemalloc.start()
    try:
        found = sum(len(chunk.token) for chunk in katz.chunks(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == 2500 * 1001
    assert peak < 100 << 20


def test_a_worker_gives_memory_back_around_a_task(monkeypatch):
    seen = []
    monkeypatch.setattr(textbytes, "give_back", lambda: seen.append("given back"))
    assert [seen.append(x) or x for x in katz._lean(lambda batches: (2 * b for b in batches))([1, 2])] == [2, 4]
    assert seen == ["given back", 2, 4, "given back"]
