import random

import numpy as np
import pyarrow as pa
from marketlens.llm import toxicity
from marketlens.llm.textbytes import flat
from marketlens.llm.toxicity import FEATURES, Words, features, fit, isotonic, properties, scored

from tests.llm.tools import frame, words

RUDE = ["blarg", "snorkwit", "zimbel"]


def labelled(n=900, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        own = words(rng, rng.randrange(5, 120)).split(" ")
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                rude = rng.choice(RUDE) if rng.random() < 0.7 else "kwag" + rng.choice(["a", "eno", "ull", "istra"])
                own.insert(rng.randrange(len(own)), rude)
        docs.append((i, " ".join(own)))
        labels.append((i, toxic))
    return docs, labels


def test_learns_words_and_beginnings(spark):
    docs, labels = labelled()
    df = frame(spark, docs)
    model = fit(df, frame(spark, labels, "doc_id long, toxic int"), lambda i: i % 5 != 0)
    assert {"=" + w for w in RUDE} | {"kwag"} <= set(model.lexicon)
    assert not any(g.startswith("=ka") for g in model.lexicon)
    found = {r.doc_id: r for r in scored(df, model).collect()}
    held = [(found[i], toxic) for i, toxic in labels if i % 5 == 0]
    assert np.mean([r.predicted == toxic for r, toxic in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    again = fit(df.repartition(2), frame(spark, labels, "doc_id long, toxic int"), lambda i: i % 5 != 0)
    assert {r.doc_id: r.score for r in scored(df, again).collect()} == {i: r.score for i, r in found.items()}


def test_odd_rows(spark):
    docs, labels = labelled(300)
    model = fit(frame(spark, docs), frame(spark, [*labels, (None, 1), (5, None)], "doc_id long, toxic int"))
    rows = [(1, None, 0.5), (2, "", 0.5), (None, "blarg " * 4000, 0.5), (None, "blarg " * 4000, 0.5), (7, "!!!", 0.5)]
    df = frame(spark, rows, "doc_id long, text string, score double")
    found = scored(df, model).collect()
    assert len(found) == 5 and {r.predicted for r in found if r.text and "blarg" in r.text} == {1}
    assert {r.predicted for r in found if not r.text} == {0}
    assert scored(df.limit(0), model).collect() == []
    nothing = fit(df, frame(spark, [], "doc_id long, toxic int"))
    assert {r.score for r in scored(df, nothing).collect()} == {0.0}
    only = fit(frame(spark, docs), frame(spark, [(1, 1), (2, 1)], "doc_id long, toxic int"))
    assert {r.score for r in scored(df, only).collect()} == {1.0}


def test_properties_of_words():
    lexicon = {"=blarg": 3.0, "snor": 2.0}
    name = {n: i for i, n in enumerate("weight hit disguised hidden second repeats capital exclamations questions signs letters capitals".split())}

    def of(token, key):
        return properties(token, lexicon)[name[key]]

    assert of("Blarg,", "weight") == 3 and of("snorting", "weight") == 2 and of("kind", "hit") == 0
    for token in ("bl4rg", "b.l.a.r.g", "blaaaarg", "bl@rg!"):
        assert of(token, "hidden") == 1 and of(token, "weight") == 3, token
    assert of("blarg!!", "hidden") == 0 and of("blarg!!", "exclamations") == 2
    assert of("YOU", "second") == 1 and of("YOU", "capital") == 1 and of("thou", "second") == 0
    assert of("1234", "letters") == 0 and of("%%%", "signs") == 3


def test_features_by_hand():
    texts = ["", "you blarg and one two three four five six blarg", "x BLARG", None]
    x = features(*flat(pa.array(texts)), Words({"=blarg": 2.0}))
    column = {n: x[:, i] for i, n in enumerate(FEATURES)}
    assert column["hits"].tolist() == [0, 2, 1, 0]
    assert column["near_second"].tolist() == [0, 1, 0, 0]
    assert column["hit_rate"].tolist() == [0, 0.2, 0.5, 0] and column["capital_words"][2] == 0.5
    assert column["kinds"][1] == 1 and column["weight_most"].tolist() == [0, 2, 2, 0]


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(1)
    score = rng.random(300).round(2)
    y = (rng.random(300) < score).astype(float)
    xs, ps = isotonic(score, y)
    assert (np.diff(ps) >= 0).all() and (np.diff(xs) >= 0).all()
    fitted = np.interp(score, xs, ps)
    assert abs(fitted.sum() - y.sum()) < 1e-6
    for shift in (0.9, 1.1):
        assert ((fitted - y) ** 2).sum() <= ((np.clip(fitted * shift, 0, 1) - y) ** 2).sum()


def test_words_are_forgotten_and_met_again(monkeypatch):
    monkeypatch.setattr(toxicity, "KNOWN_WORDS", 3)
    seen = Words({"=blarg": 2.0})
    data = [flat(pa.array([f"blarg one{i} two{i} three{i}", "you"])) for i in range(5)]
    rows = [features(*d, seen) for d in data]
    assert all((r == rows[0]).all() for r in rows)


def test_repeated_ids_give_the_same_rows_however_they_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 4)
    rows = [(i % 4, "word " * (1 + i % 7) + "!" * (i % 5)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0)], "doc_id long, toxic int")
    kept = []

    class Rows:
        def __init__(self, lexicon, x, y, fold):
            kept.append((x.tolist(), y.tolist(), fold.tolist()))

    monkeypatch.setattr(toxicity, "Classifier", Rows)
    for n, order in ((1, "text"), (7, "doc_id"), (3, "text")):
        toxicity.fit(docs.orderBy(order).repartition(n), labels)
    assert len(kept[0][0]) == 8
    assert kept[0] == kept[1] == kept[2]
