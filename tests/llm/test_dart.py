import random
from collections import Counter

import numpy as np
import pytest
from marketlens.llm import dart
from marketlens.llm.components import components
from marketlens.llm.dart import near_duplicates, shingles, signatures
from marketlens.llm.textbytes import flat

from tests.llm.test_decontam import split
from tests.llm.tools import corpus, frame, words


def weights(text, n=5):
    own = split(text)
    return Counter(tuple(own[i : i + n]) for i in range(max(len(own) - n, 0) + 1)) if own else Counter()


def similarity(a, b):
    either = sum((a | b).values())
    return sum((a & b).values()) / either if either else 0.0


def brute(rows, least=0.8):
    rows = sorted(rows)
    sets = [weights(text) for _, text in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "") if not sets[i] and not sets[j] else False
            if same or (sets[i] and split(rows[i][1]) == split(rows[j][1])) or similarity(sets[i], sets[j]) >= least:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def near_corpus(seed, n=80):
    rng = random.Random(seed)
    rows = corpus(n, seed)
    long = [words(rng, 200) for _ in range(4)]
    for i in range(60):
        own = rng.choice(long).split(" ")
        for _ in range(rng.randrange(12)):
            own[rng.randrange(len(own))] = rng.choice("xyzuvw") * 3
        rows.append((1000 + i, " ".join(own)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    rows = near_corpus(seed)
    found = {r.doc_id: r.class_id for r in near_duplicates(frame(spark, rows)).collect()}
    assert found == brute(rows)


def test_hot_group_and_several_partners(spark, monkeypatch):
    monkeypatch.setattr(dart, "PARTNERS", 5)
    rng = random.Random(9)
    text = words(rng, 300)
    rows = [(i, text + " " + words(rng, 10)) for i in range(60)] + [(100 + i, text) for i in range(20)]
    found = {r.doc_id: r.class_id for r in near_duplicates(frame(spark, rows)).collect()}
    assert set(found.values()) == {0} and len(found) == 80


def test_chains_of_links_in_small_blocks(spark, monkeypatch):
    """Texts that drift apart: many share buckets without being alike, links connect neighbours."""
    monkeypatch.setattr(dart, "BLOCK_TEXTS", 6)
    rng = random.Random(4)
    rows, own = [], words(rng, 120).split(" ")
    for i in range(90):
        own = list(own)
        for _ in range(rng.randrange(1, 4)):
            own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
        rows.append(((i * 37) % 91, " ".join(own)))
    found = {r.doc_id: r.class_id for r in near_duplicates(frame(spark, rows)).collect()}
    assert found == brute(rows) and 1 < len(set(found.values())) < 60


def test_odd_rows(spark):
    text = "eins zwei drei vier fuenf sechs sieben"
    rows = [(5, text, 1), (5, text, 1), (5, "other words here", 1), (None, text.upper(), 1), (7, None, 1), (8, "", 1), (9, "!?", 1)]
    df = frame(spark, rows, "doc_id long, text string, label int")
    found = near_duplicates(df).collect()
    assert len(found) == 7
    by_id = Counter((r.doc_id, r.class_id) for r in found)
    assert by_id == Counter({(5, 5): 3, (None, 5): 1, (7, 7): 1, (8, 7): 1, (9, 9): 1})
    assert near_duplicates(df.limit(0)).collect() == []


def test_coordinates_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(3)
    element = rng.integers(1, 2**63, 60).astype(np.uint64)
    sets = [(np.arange(0, 40), rng.integers(1, 6, 40)), (np.arange(10, 60), rng.integers(1, 6, 50)), (np.arange(0, 40), rng.random(40) * 3)]
    flat_element = np.concatenate([element[i] for i, _ in sets])
    weight = np.concatenate([w for _, w in sets]).astype(float)
    text = np.repeat(np.arange(3), [len(i) for i, _ in sets])
    names = signatures(flat_element, weight, text, 3, 4096)
    assert (names != 0).all()
    for a in range(3):
        for b in range(a):
            dense = np.zeros((2, 60))
            dense[0, sets[a][0]], dense[1, sets[b][0]] = sets[a][1], sets[b][1]
            expected = dense.min(axis=0).sum() / dense.max(axis=0).sum()
            assert abs((names[a] == names[b]).mean() - expected) < 0.035


def test_signatures_do_not_depend_on_company():
    import pyarrow as pa

    texts = [t or "" for _, t in corpus(30)]
    alone = [signatures(*shingles(*flat(pa.array([t]))), 1, 128)[0] for t in texts]
    together = signatures(*shingles(*flat(pa.array(texts))), len(texts), 128)
    assert (np.array(alone) == together).all()
    assert (together[[i for i, t in enumerate(texts) if split(t)]] != 0).all()


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)]
    label = {i: i for link in links for i in link}
    for _ in range(200):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    found = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {n: m for n, m in label.items() if n in found} and len(found) > 100
    assert all(label[n] == n for n in label if n not in found)
