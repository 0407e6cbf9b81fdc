"""A training corpus from documents: each stage works on what the one before has kept.

Stages take (spark, docs, sf_dir) and return the columns of documents, the last one packed pieces.
Rows with nulls, empty or repeated rows and further columns are handled as the operators say.
"""

import public_tokenizers
from marketlens.llm import dart, decontam, packing, suffix_dedup, toxicity
from marketlens.llm.runtime import stored, table
from pyspark.sql import functions as F


def without_toxic(spark, docs, sf_dir):
    """Documents that the classifier doesn't predict to be toxic.

    It learns from the labelled documents among `docs` whose crc32(doc_id) mod 5 isn't 0. Rows
    that repeat are judged alike; a text without words is judged by the classifier as well.
    """
    labels = table(spark, sf_dir, "labels")
    crc = lambda doc_id: F.crc32(doc_id.cast("string").cast("binary"))
    classifier = toxicity.fit(docs, labels, lambda doc_id: crc(doc_id) % 5 != 0)
    judged = toxicity.scored(docs, classifier, prefix="toxicity_")
    return judged.filter("toxicity_predicted = 0").select(docs.columns)


def without_near_copies(spark, docs, sf_dir):
    """The first document, by id, of each class of near duplicates; a repeated row stays once."""
    return dart.one_of_each_class(docs)


def without_repeated_passages(spark, docs, sf_dir):
    """All documents, without the 100-byte strings that occur earlier; n_chars is the new length."""
    return suffix_dedup.deduplicated(docs)


def without_benchmark(spark, docs, sf_dir):
    """Documents in which no window of a benchmark item occurs."""
    judged = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), prefix="benchmark_")
    return judged.filter("NOT benchmark_contaminated").select(docs.columns)


def packed(spark, docs, sf_dir):
    """A row per piece of a document, with its sequence of at most 2048 tokens and its place."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_copies),
    ("suffix_dedup", without_repeated_passages),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: The classifier and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; each one's result is a stored table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
