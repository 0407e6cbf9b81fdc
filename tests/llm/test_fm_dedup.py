import random
import re

import numpy as np
from marketlens.llm import anchors, fm_dedup
from marketlens.llm.fm_dedup import remove_repeats
from marketlens.llm.fmindex import FMIndex

from tests.llm.tools import corpus, frame, sha, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=35):
    texts = {doc_id: WORD.findall(text or "") for doc_id, text in rows}
    places = {}
    for doc_id, own in texts.items():
        for i in range(len(own) - window + 1):
            places.setdefault(tuple(own[i : i + window]), []).append((doc_id, i))
    gone = {doc_id: set() for doc_id in texts}
    for found in places.values():
        if len(found) > 1:
            for doc_id, i in found:
                gone[doc_id].update(range(i, i + window))
    return {
        doc_id: (len(own), len(gone[doc_id]), sha(" ".join(w for i, w in enumerate(own) if i not in gone[doc_id])))
        for doc_id, own in texts.items()
    }


def result(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_matches_brute_force(spark):
    rows = corpus(80, 8)
    assert result(remove_repeats(frame(spark, rows))) == brute(rows)


def test_many_shards_and_small_blocks(spark, monkeypatch):
    rng = random.Random(3)
    middle = words(rng, 45)
    rows = [(i, words(rng, rng.randrange(60)) + " " + middle + "\n" + words(rng, rng.randrange(50))) for i in range(90)]
    rows += [(i + 200, text) for i, text in rows[:10]] + [(400, "la " * 200), (401, words(rng, 34)), (402, "é " * 35)]
    monkeypatch.setattr(anchors, "SHARD_REGIONS", 6)
    monkeypatch.setattr(fm_dedup, "BLOCK_WORDS", 900)
    assert result(remove_repeats(frame(spark, rows, parts=5))) == brute(rows)


def test_odd_rows(spark):
    rng = random.Random(1)
    text = words(rng, 60)
    rows = [(1, text, 0), (1, text, 0), (2, None, 0), (3, "", 0), (None, words(rng, 50), 0)]
    df = frame(spark, rows, "doc_id long, text string, variant int")
    found = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in remove_repeats(df).collect())
    assert found == [(-1, 50, 0), (1, 60, 0), (1, 60, 0), (2, 0, 0), (3, 0, 0)]
    assert remove_repeats(df.limit(0)).collect() == []
    again = frame(spark, [(1, text, 0), (1, text + " more", 0), (None, text, 0)], "doc_id long, text string, variant int")
    assert sorted(r.n_removed for r in remove_repeats(again).collect()) == [60, 60, 60]


def test_backward_search_counts_and_finds_windows():
    rng = np.random.default_rng(5)
    text = rng.integers(1, 5, 400)
    index = FMIndex(text, 5)
    listed = text.tolist()
    low, high = np.zeros(1, np.int64), np.array([index.size])
    for i in (17, 16, 15, 14, 13):
        low, high = index.extended(text[i : i + 1], low, high)
        part = listed[i:18]
        n = sum(listed[j : j + len(part)] == part for j in range(400))
        assert high[0] - low[0] == n
    starts, sizes, window = np.arange(0, 400, 40), np.full(10, 40), 6
    row, start, size = index.repeated_windows(starts, sizes, window)
    found = np.zeros(400, bool)
    for r, s, n in zip(row, start, size, strict=True):
        found[starts[r] + s : starts[r] + s + n] = True
    expected = np.zeros(400, bool)
    for a in starts:
        for i in range(a, a + 40 - window + 1):
            part = listed[i : i + window]
            if sum(listed[j : j + window] == part for j in range(395)) > 1:
                expected[i : i + window] = True
    assert (found == expected).all()
