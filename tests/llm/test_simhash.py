import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marketlens.llm import grayindex, simhash
from tests.llm.tools import WORDS, corpus, frame, words


def fingerprint(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(found[i : i + 3]) for i in range(max(len(found) - 2, 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def groups_of(codes, most):
    """The smallest code that each code reaches, by looking at all pairs."""
    label = {c: c for c in codes}
    for a in codes:
        for b in codes:
            if (a ^ b).bit_count() <= most and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {c: low if v == high else v for c, v in label.items()}
    return label


def expected(rows, most=3):
    prints = [(i, fingerprint(t)) for i, t in rows]
    label = groups_of({p for _, p in prints}, most)
    first = {}
    for i, p in prints:
        if i is not None:
            first[label[p]] = min(i, first.get(label[p], i))
    return sorted(((i, f"{p:016x}", first.get(label[p])) for i, p in prints), key=str)


def found(spark, rows, **how):
    df = frame(spark, rows).withColumn("code", F.lit(1)).withColumn("label", F.lit("x"))
    return sorted((tuple(r) for r in simhash.near_duplicates(df, **how).collect()), key=str)


@pytest.mark.parametrize("text", ["", None, " \t", "One", "one TWO", "Ä b\x0bC d", "a b\x1cc d\x85e f g", "x " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == fingerprint(text)


def test_fingerprint_of_a_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 50)
    rng = random.Random(3)
    for text in (words(rng, 400), "y" * 300 + " " + words(rng, 30), " " * 200 + "a" + "\n" * 120 + "b c"):
        assert simhash.fingerprint(text) == fingerprint(text)


def some_codes(rng, n):
    base = [rng.getrandbits(64) for _ in range(max(1, n // 6))]
    codes = {0}
    while len(codes) < n:
        code = rng.choice(base)
        for _ in range(rng.randrange(5)):
            code ^= 1 << rng.randrange(64)
        codes.add(code)
    return codes


@pytest.mark.parametrize("n", [1, 7, 8, 9, 65, 300])
def test_index_against_all_pairs(n):
    codes = np.array(list(some_codes(random.Random(n), n)), np.uint64)
    codes = codes[np.argsort(grayindex.gray_rank(codes))]
    labels = grayindex.components(codes, 3)
    label = groups_of([int(c) for c in codes], 3)
    assert len({(int(a), label[int(c)]) for a, c in zip(labels, codes)}) == len(set(label.values())) == len(set(labels))


def test_gray_order():
    codes = np.arange(64, dtype=np.uint64)
    in_order = codes[np.argsort(grayindex.gray_rank(codes))]
    assert all(int(a ^ b).bit_count() == 1 for a, b in zip(in_order, in_order[1:]))


@pytest.mark.parametrize("group", [5, 40, 50_000])
def test_links_of_groups_that_are_dealt_further(spark, group):
    rng = random.Random(6)
    # A dense cluster: nearly all of it agrees in any block of bits.
    codes = some_codes(rng, 200)
    codes |= {1234567 ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)}
    signed = [c - 2**64 if c >= 2**63 else c for c in codes]
    df = spark.createDataFrame([(c,) for c in signed], "code long")
    rows = simhash.links(df, group=group).collect()
    linked = {c: c for c in codes}
    for a, b in ((r.a % 2**64, r.b % 2**64) for r in rows):
        low, high = sorted((linked[a], linked[b]))
        linked = {c: low if v == high else v for c, v in linked.items()}
    assert linked == groups_of(codes, 3)


def test_documents(spark):
    rng = random.Random(2)
    rows = corpus(120)
    # Long texts with few changed words differ in few bits.
    text = words(rng, 700).split(" ")
    for i in range(40):
        changed = list(text)
        for _ in range(rng.randrange(1, 4)):
            changed[rng.randrange(len(changed))] = rng.choice(WORDS) + "x"
        rows.append((1000 + i, " ".join(changed)))
    rows += [(None, "only words"), (None, rows[3][1]), (5, "Only Words"), rows[0], rows[0], (77, "long " * 400_000)]
    result = found(spark, rows)
    assert result == expected(rows)
    assert len({c for i, _, c in result if i and 1000 <= i < 1040}) < 40
    assert found(spark, rows, group=4) == result


def test_empty_tables_and_missing_ids(spark):
    assert found(spark, []) == []
    rows = [(None, "a b c d"), (None, "a b c d"), (None, None), (3, "")]
    assert found(spark, rows) == expected(rows)
