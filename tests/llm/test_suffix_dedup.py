import random

import numpy as np
from marketlens.llm import anchors, suffix_dedup, textbytes
from marketlens.llm.suffix_dedup import deduplicated, remove_repeats

from tests.llm.tools import corpus, frame, sha


def brute(rows, window=100):
    """(n_bytes, n_removed, n_spans, kept_sha256) by a set of all strings met so far."""
    met, out = set(), {}
    for doc_id, text in sorted(rows):
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - window + 1):
            part = data[i : i + window]
            if part in met:
                gone[i : i + window] = [True] * window
            met.add(part)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[doc_id] = (len(data), sum(gone), spans, sha(kept))
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_matches_brute_force(spark):
    rows = corpus()
    assert result(remove_repeats(frame(spark, rows))) == brute(rows)


def test_many_shards_of_one_anchor_and_slices(spark, monkeypatch):
    rng = random.Random(3)
    middle = "shared passage of some length that every document holds, at another place. " * 2
    rows = [
        (i, "".join(rng.choice("abcd ") for _ in range(rng.randrange(150))) + middle
         + "".join(rng.choice("abcd ") for _ in range(80)))
        for i in range(120)
    ]
    monkeypatch.setattr(anchors, "SHARD_REGIONS", 7)
    assert result(remove_repeats(frame(spark, rows, parts=5))) == brute(rows)


def test_repetition_inside_a_text(spark):
    rows = [(1, "ab" * 300), (2, "x" * 99), (3, "x" * 100), (4, "x" * 100), (5, "é" * 130)]
    assert result(remove_repeats(frame(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    text = "one row that is repeated whole, with a text of more than a hundred bytes " * 2
    rows = [(1, text, "a"), (1, text, "a"), (2, text[:120], "b"), (None, text, "c"), (7, None, "d"), (8, "", "e")]
    df = frame(spark, rows, "doc_id long, text string, key string")
    found = sorted((r.doc_id is None, r.doc_id, r.n_removed, r.n_bytes) for r in remove_repeats(df).collect())
    assert found == [
        (False, 1, found[0][2], 146), (False, 1, found[0][2], 146), (False, 2, 120, 120),
        (False, 7, 0, 0), (False, 8, 0, 0), (True, None, 146, 146),
    ]
    assert remove_repeats(df.limit(0)).collect() == []
    kept = deduplicated(df)
    assert kept.columns == df.columns
    texts = {(r.doc_id, r.key): r.text for r in kept.collect()}
    assert texts[(2, "b")] == "" and texts[(7, "d")] is None and texts[(None, "c")] == ""
    assert kept.count() == 6


def test_cuts_whole_characters(spark):
    rows = [(1, "é" * 60 + "ab" * 20, 100), (2, "é" * 60 + "zz", 62)]
    df = frame(spark, rows, "doc_id long, text string, n_chars long")
    kept = {r.doc_id: r for r in deduplicated(df).collect()}
    assert kept[2].text.endswith("zz") and set(kept[2].text) <= {"é", "z"}
    assert kept[2].n_chars == len(kept[2].text)


def test_blocks_of_a_few_bytes(spark, monkeypatch):
    rows = corpus(seed=11)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 500)
    assert result(remove_repeats(frame(spark, rows))) == brute(rows)


def test_one_anchor_with_more_bytes_than_a_suffix_array_holds(spark):
    """At the production constants; fewer regions than make a second shard by their number."""
    # A phrase that is the anchor of any window that holds it: the least of many hashes.
    phrases = np.random.default_rng(9).integers(97, 123, (1 << 18, 20)).astype(np.uint8)
    at = np.arange(len(phrases)) * 20
    hashes = textbytes.mixed(textbytes.RangeHash(phrases.ravel()).of(at, at + 20))
    phrase = phrases[hashes.argmin()].tobytes().decode()
    rng = random.Random(9)
    around = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=90)) for _ in range(19_900)]
    after = around[1000:] + around[:1000]
    # Every tenth has the text before the phrase of the one before it: a repeat across regions.
    rows = [
        (i, around[i - (i % 10 == 1)] + phrase + after[i])
        for i in range(len(around) - 100)
    ]
    found = result(remove_repeats(frame(spark, rows, parts=4)))
    assert found == brute(rows)
    assert sum(r[1] > 0 for r in found.values()) > 1900
