import random
import re

from marketlens.llm import decontam
from marketlens.llm.decontam import contamination

from tests.llm.tools import frame, sha, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    out = {}
    for doc_id, text in docs:
        own = split(text)
        hit, found = set(), set()
        for item_id, item in items:
            parts = split(item)
            for j in range(max(len(parts) - window, 0) + 1 if parts else 0):
                part = parts[j : j + window]
                for i in range(len(own) - len(part) + 1):
                    if own[i : i + len(part)] == part:
                        hit.update(range(i, i + len(part)))
                        found.add(str(item_id))
        out[doc_id] = (len(own), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def tables(seed=4):
    rng = random.Random(seed)
    items = [(i, words(rng, rng.randrange(3, 40))) for i in range(25)]
    items += [(100, None), (101, " ,; "), (102, "KALO reS!")]
    docs = []
    for i in range(50):
        text = words(rng, rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            item = rng.choice(items[:25])[1].split(" ")
            low = rng.randrange(len(item))
            part = " ".join(item[low : low + rng.randrange(4, 30)])
            text += rng.choice([" ", "\n", "-", " Á "]) + rng.choice([part, part.upper(), part.replace(" ", ", ")])
            text += rng.choice(["", ".", " "]) + words(rng, rng.randrange(5))
        docs.append((i, text))
    return docs + [(60, None), (61, ""), (62, "kalo res kalo res")], items


def result(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def test_matches_brute_force(spark):
    docs, items = tables()
    found = contamination(frame(spark, docs), frame(spark, items, "item_id long, text string"))
    assert result(found) == brute(docs, items)


def test_several_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 300)
    docs, items = tables(9)
    found = contamination(frame(spark, docs), frame(spark, items, "item_id long, text string"))
    assert result(found) == brute(docs, items)


def test_spans_lie_in_the_original_text(spark):
    item = "one two three four five six seven eight nine ten"
    text = "é È-One,TWO three\nfour five six  seven eight nine ten!"
    found = contamination(frame(spark, [(1, text)]), frame(spark, [(1, item)], "item_id long, text string")).first()
    (span,) = found.spans
    assert text.encode()[span.start : span.end].decode() == text[4:-1]


def test_odd_rows(spark):
    docs = frame(spark, [(1, "a b", 9), (1, "a b", 9), (None, "c", 9)], "doc_id long, text string, n_words int")
    items = frame(spark, [(1, "a b"), (1, "a b"), (None, "c")], "item_id long, text string")
    rows = contamination(docs, items).collect()
    assert len(rows) == 3 and all(r.contaminated for r in rows) and {r.n_words for r in rows} == {1, 2}
    assert not any(r.contaminated for r in contamination(docs, items.limit(0)).collect())
    assert contamination(docs.limit(0), items).collect() == []
