import random

import corpus_pipeline
import public_tokenizers
import pytest
from marketlens.llm.tokens import Encoder
from pyspark.sql import functions as F

from tests.llm.test_dart import brute as near_classes
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_suffix_dedup import brute as repeats
from tests.llm.tools import frame, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    items = [(i, words(rng, 30)) for i in range(5)]
    passage = words(rng, 60)
    docs, labels = [], []
    for i in range(400):
        text = words(rng, rng.randrange(20, 160))
        toxic = int(rng.random() < 0.2)
        if toxic:
            text += " blarg you blarg"
        if i % 11 == 0:
            text += " " + items[i % 5][1]
        if i % 13 == 0:
            text += " " + passage
        if i % 17 == 0 and docs:
            text = docs[-1][1].replace("ka", "KA")
            toxic = labels[-1][2]
        docs.append((i, text))
        labels.append((i, 1, toxic))
    docs += [(500, None), (501, ""), (502, docs[3][1])]
    top = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in docs]
    frame(spark, rows, SCHEMA).write.parquet(f"{top}/documents.parquet")
    frame(spark, labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    frame(spark, items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top, dict(docs), {i: t for i, _, t in labels}, items


def test_stages_against_brute_force(spark, folder):
    top, texts, toxic, items = folder
    docs = spark.read.parquet(f"{top}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, top)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept = {r.doc_id: r.text for r in docs.collect()}
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if name == "toxicity":
            assert kept == {i: t for i, t in texts.items() if "blarg" not in (t or "")}
        if name == "near_dedup":
            classes = near_classes(list(before.items()))
            assert kept == {i: before[i] for i in set(classes.values())}
        if name == "suffix_dedup":
            expected = repeats(list(before.items()))
            assert set(kept) == set(before) and sum(e[1] for e in expected.values()) > 0
            for i, text in kept.items():
                assert abs(len((text or "").encode()) - (expected[i][0] - expected[i][1])) <= 2 * expected[i][2]
        if name == "decontamination":
            hits = contaminated(list(before.items()), items)
            assert kept == {i: t for i, t in before.items() if not hits[i][4]}
            assert len(kept) < len(before)


def test_run_packs_what_is_kept(spark, folder):
    top = folder[0]
    rows = corpus_pipeline.run(spark, top).collect()
    coder = Encoder(public_tokenizers.path("byte_bpe_50k.json")).tokenizer
    ids = {r.doc_id for r in rows}
    assert len(ids) == len(rows) > 100 and {500, 501} & ids
    assert all(r.length <= 2048 and r.offset + r.length <= 2048 for r in rows)
    assert coder.get_vocab_size() == 50257


def test_stages_take_odd_tables(spark, folder):
    top = folder[0]
    rows = [
        (None, "one text without id", "en", None, None, 1), (9, None, None, None, None, 2), (9, "", None, None, 0, 3),
        (8, "twice " * 50, "x", "s", 300, 4), (8, "twice " * 50, "x", "s", 300, 4),
    ]
    df = frame(spark, rows, SCHEMA + ", label int")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, df.limit(0), top)
        assert empty.collect() == []
        assert len(stage(spark, df, top).collect()) in (3, 4, 5)
    assert df.select(F.col("label")).count() == 5
