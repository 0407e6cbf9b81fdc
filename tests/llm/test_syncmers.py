import random

import pytest
from marketlens.llm.syncmers import (
    as_text,
    edit_fingerprints,
    likeness,
    long_fingerprints,
    with_char_fingerprint,
    with_fingerprint,
)
from pyspark.sql import functions as F

from tests.llm.tools import corpus, frame, sha, words


def test_edited_texts(spark):
    rows = corpus(60) + [(1000, "x"), (-5, "first one in order of ids")]
    found = {r.doc_id: r for r in edit_fingerprints(frame(spark, rows)).collect()}
    assert len(found) == len(rows)
    rows = sorted((i, t or "") for i, t in rows)
    same = {}
    for (doc_id, text), (next_id, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(text) // 4
        r = found[doc_id]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == sha(text[: len(text) - n] + after[:n])
        assert same.setdefault(text, r.fingerprint) == r.fingerprint
        if len(text) > 400 and text != after:
            assert 0.3 < r.near_edited <= 1
        assert (r.near_next == 1) == (r.fingerprint == found[next_id].fingerprint) or r.near_next < 1
    longer = [r for r in found.values() if r.n_chars > 300]
    assert sum(r.near_edited > r.near_next for r in longer) > 0.8 * len(longer)


def closed_syncmers(tokens, hash_of, k=4):
    """By definition: k-mers whose smallest token is the first or the last one."""
    padded = [hash_of[t] for t in tokens] + [2**63 - 1] * (k - 1)
    return [
        i + 1 for i in range(len(tokens))
        if min(padded[i : i + k]) in (padded[i], padded[i + k - 1])
    ]


@pytest.mark.parametrize("text", ["", "a", "a b c", " one  two\nthree ", "x" * 40, None])
def test_places_by_definition(spark, text):
    rng = random.Random(3)
    texts = [text, words(rng, 120)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in with_fingerprint(df, "text", "anchors").collect():
        tokens = [w[i : i + 16] for w in (r.text or "").split() for i in range(0, len(w), 16)]
        hashes = {t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0] for t in set(tokens)}
        assert [a.place for a in r.anchors] == closed_syncmers(tokens, hashes)


def test_anchors_do_not_depend_on_context(spark):
    rng = random.Random(4)
    passage = words(rng, 40)
    rows = [(1, words(rng, 30) + " " + passage + " " + words(rng, 20)), (2, passage + " " + words(rng, 9))]
    sets = [
        {a.hash for a in r.anchors}
        for r in with_fingerprint(frame(spark, rows), "text", "anchors").collect()
    ]
    inner = with_fingerprint(frame(spark, [(1, passage)]), "text", "anchors").first().anchors
    inner = {a.hash for a in inner if a.place <= 37}
    assert inner and all(inner <= s for s in sets)


def test_likeness(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], []), ([1], [])], "a array<long>, b array<long>")
    assert [r[0] for r in df.select(likeness("a", "b")).collect()] == [0.5, 1.0, 0.0]


def test_odd_rows(spark):
    rows = [(1, "a b c d e f g h", "x"), (1, "a b c d e f g h", "x"), (None, "last words of all", "x"), (4, None, "x")]
    df = frame(spark, rows, "doc_id long, text string, range string")
    found = edit_fingerprints(df).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_chars) for r in found) == [
        (False, 1, 15), (False, 1, 15), (False, 4, 0), (True, None, 17)]
    (last,) = [r for r in found if r.doc_id is None]
    assert last.edited_sha256 == sha("last words of" + "a b ")
    assert edit_fingerprints(df.limit(0)).collect() == []


def test_short_texts_and_unbroken_runs_share_anchors(spark):
    rng = random.Random(8)
    run = "".join(rng.choices("abcdefghij日本語👩", k=400))
    texts = {1: "uncommonly lengthy designations", 2: "interdepartmental reorganisation plan", 3: run,
             4: run[:3] + "z" + run[3:], 5: "short", 6: ""}
    found = {r.doc_id: r for r in edit_fingerprints(frame(spark, list(texts.items()))).collect()}
    assert found[1].near_edited > 0 and found[2].near_edited > 0
    assert found[3].near_next > 0.9 and found[3].near_edited > 0.5
    # The edited text's fingerprint, put together from two, is that of the whole text.
    edited = [
        (i, t[: len(t) - len(t) // 4] + texts[i % 6 + 1][: len(t) // 4]) for i, t in texts.items()
    ]
    whole = with_char_fingerprint(frame(spark, edited), "text", "anchors")
    for r in whole.select("doc_id", as_text(F.col("anchors.hash")).alias("f")).collect():
        assert found[r.doc_id].edited_fingerprint == r.f


def test_edited_texts_are_not_read_through_again(spark, monkeypatch):
    """Two texts of a few characters, not a quarter of each, are all that is looked through again."""
    looked_at = []
    found = with_char_fingerprint

    def noted(df, text_col, to):
        looked_at.append((text_col, df))
        return found(df, text_col, to)

    monkeypatch.setattr("marketlens.llm.syncmers.with_char_fingerprint", noted)
    rng = random.Random(11)
    # Of every length, so that what is put in is of every length up to 40, and often ends early.
    texts = {i: words(rng, 60)[: rng.choice([i, 160, 7])] for i in range(160)}
    texts[50] = "日本語👩 " * 30
    rows = {r.doc_id: r for r in edit_fingerprints(frame(spark, list(texts.items()))).collect()}
    of_edited = [df.agg(F.max(F.char_length(c))).first()[0] for c, df in looked_at if c not in ("text", "after")]
    assert of_edited and max(of_edited) <= 22
    edited = [
        (i, t[: len(t) - len(t) // 4] + texts[(i + 1) % 160][: len(t) // 4]) for i, t in texts.items()
    ]
    whole = found(frame(spark, edited), "text", "anchors").select("doc_id", F.col("anchors.hash").alias("hashes"))
    own = found(frame(spark, list(texts.items())), "text", "anchors")
    own = own.select("doc_id", F.col("anchors.hash").alias("own"))
    for r in whole.join(own, "doc_id").select("doc_id", as_text("hashes").alias("f"), likeness("own", "hashes").alias("l")).collect():
        assert (rows[r.doc_id].edited_fingerprint, rows[r.doc_id].near_edited) == (r.f, r.l)
        assert rows[r.doc_id].edited_sha256 == sha(dict(edited)[r.doc_id])


def test_anchors_of_rows_per_character(spark):
    """Texts are looked through in rows that Spark compiles, without a shuffle; the anchors are those by definition."""
    rng = random.Random(12)
    texts = ["", "a", "日本語👩 " * 9, "x" * 40, "\n".join("ab" * i for i in range(9)), words(rng, 300), "x" * 40]
    # More texts of a group than the aggregate keeps before it sorts.
    texts += [words(rng, 5)[: i % 31] for i in range(400)]
    rows = [(i, t, i % 2) for i, t in enumerate(texts)]
    df = frame(spark, rows, "doc_id long, text string, range int").repartition(2, "range")
    found = long_fingerprints(df, "range")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "posexplode" in plan
    of_rows = {r.doc_id: r for r in found.collect()}
    assert len(of_rows) == len(rows)
    of_arrays = {r.doc_id: r for r in with_char_fingerprint(df, "text", "anchors").collect()}
    for i, text, group in rows:
        assert (of_rows[i].text, of_rows[i].range) == (text, group)
        assert of_rows[i].anchors == of_arrays[i].anchors
    parts = {t[j : j + 4] for t in texts for j in range(len(t))}
    hashed = frame(spark, list(enumerate(parts))).select("text", F.xxhash64("text").alias("h")).collect()
    hashes = {r.text: r.h for r in hashed}
    for i, text, _ in rows:
        of_text = [text[j : j + 4] for j in range(len(text))]
        assert [a.place for a in of_rows[i].anchors] == closed_syncmers(of_text, hashes, 9)


def test_ranges_follow_the_size_of_the_texts(spark, monkeypatch):
    rows = corpus(80)
    wide = sorted(edit_fingerprints(frame(spark, rows)).collect())
    monkeypatch.setattr("marketlens.llm.syncmers.RANGE_BYTES", sum(len((t or "").encode()) for _, t in rows) // 40)
    narrow = edit_fingerprints(frame(spark, rows))
    assert "REPARTITION_BY_NUM" in narrow._jdf.queryExecution().executedPlan().toString()
    assert narrow.rdd.getNumPartitions() >= 40 > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(narrow.collect()) == wide
