"""Small tables and brute-force versions for the tests."""

import hashlib
import random

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "tä", "re") for b in ("", "s", "nd", "ß", "lo", "mira")]


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(n=60, seed=5):
    """(doc_id, text): prose, copies, near copies, shared passages, empty, null, very long."""
    rng = random.Random(seed)
    passage = words(rng, 60)
    line = words(rng, 25)
    texts = []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.3:
            old = (rng.choice(texts) or "x").split(" ")
            old[rng.randrange(len(old))] = "changed"
            texts.append(" ".join(old))
        elif kind < 0.5:
            texts.append(words(rng, rng.randrange(40)) + "\n" + passage + "\t" + words(rng, rng.randrange(60)))
        elif kind < 0.6:
            texts.append((line + " ") * rng.randrange(1, 4) + words(rng, 10))
        elif kind < 0.65:
            texts.append(rng.choice(["", None, " ", "a", "ab" * 120]))
        else:
            texts.append(words(rng, rng.randrange(1, 150)))
    texts.append(words(rng, 3000) + passage + words(rng, 50))
    return [(i * 3, text) for i, text in enumerate(texts)]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def frame(spark, rows, schema="doc_id long, text string", parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)
