"""Toxicity of texts: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from labelled rows: words, and beginnings of words, that occur in toxic
texts far more often than chance explains. Features are densities of its entries, how close they
are to words of the second person, capitals, punctuation and signs of obfuscation. Every word is
looked at once in Python per worker; texts are summed up as arrays.
"""

import re

import numpy as np
import pyarrow as pa
from marketlens.llm import textbytes, tokens
from marketlens.llm.runtime import ship
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: At most so many labelled rows are learned from, those with the smallest hashes of their ids.
SAMPLE_ROWS = 20_000
#: At most so many lexicon entries, those that tell most.
LEXICON = 3000
#: An entry occurs in at least so many toxic texts of the sample.
LEAST_TEXTS = 4
#: Beginnings of words with so many letters can be entries.
STEMS = (4, 5, 6)
#: Words that far apart are near each other.
NEAR = 5
SLICE_BYTES = 1 << 20
KNOWN_WORDS = 500_000

#: Words of the second person in English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen euch euer ihr tu te toi ton tes "
    "vous votre vos tú ti contigo usted ustedes tus vosotros".split()
)
#: Signs that stand for letters in obfuscated words.
_LETTERS_FOR = str.maketrans("013457@$!|", "oieastasii")
_PARTS = re.compile(r"[^\W\d_]+")
_THRICE = re.compile(r"([^\W\d_])\1\1")
_FOLDED = re.compile(r"([^\W\d_])\1+")

FEATURES = (
    "hits", "hit_rate", "kinds", "weight_rate", "weight_most", "near_second", "near_second_rate",
    "second_rate", "disguised_rate", "disguised_hits", "repeat_rate", "capital_rate",
    "capital_words", "exclamations", "questions", "punctuation", "log_words", "log_letters",
)
_PROPERTIES = 10  # weight, hit, disguised, disguised hit, second, repeats, capital, !, ?, punctuation


def _grams(word):
    """The entries that a lower-case word can match."""
    yield "=" + word
    for n in STEMS:
        if len(word) >= n:
            yield word[:n]


def properties(token, lexicon):
    """What one stretch without white space adds to the features of its text, and its letters."""
    parts = _PARTS.findall(token)
    lower = [p.lower() for p in parts]
    weight = max((lexicon.get(g, 0.0) for p in lower for g in _grams(p)), default=0.0)
    letters = sum(map(len, parts))
    capitals = sum(c.isupper() for p in parts for c in p)
    disguised = hidden = 0.0
    repeats = float(any(_THRICE.search(p) for p in lower))
    inner = token.strip("!?.,;:'\"()[]{}*#&%$/|\\-_<>~+=")
    if (len(parts) > 1 or any(c.isdigit() for c in inner)) and letters:
        disguised = float(any(not c.isalpha() for c in inner))
    if disguised or repeats:
        seen = {"".join(lower)}
        for form in (inner, token):
            plain = "".join(_PARTS.findall(form.lower().translate(_LETTERS_FOR)))
            seen |= {plain, _FOLDED.sub(r"\1", plain)}
        found = max(lexicon.get("=" + p, 0.0) for p in seen)
        hidden = float(found > weight)
        weight = max(weight, found)
    second = float(any(p in SECOND_PERSON for p in lower))
    signs = len(token) - sum(c.isalnum() for c in token)
    whole = float(capitals == letters and letters > 1)
    return (
        weight, float(weight > 0), disguised, hidden, second, repeats, whole,
        float(token.count("!")), float(token.count("?")), float(signs), float(letters), float(capitals),
    )


class Words:
    """Properties of all words met by a worker, looked up by hash."""

    def __init__(self, lexicon):
        self.lexicon = lexicon
        self.keys, self.rows = np.empty(0, np.uint64), np.empty((0, _PROPERTIES + 2), np.float32)

    def of(self, data, starts, ends):
        hashes = textbytes.RangeHash(data).of(starts, ends)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > KNOWN_WORDS:
            self.keys, self.rows = self.keys[:0], self.rows[:0]
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
            new = np.flatnonzero(self.keys[place] != distinct)
        else:
            new = np.arange(len(distinct))
        if len(new):
            raw = data.tobytes()
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            rows = [properties(raw[a:b].decode("utf-8", "replace"), self.lexicon) for a, b in spans]
            at = np.searchsorted(self.keys, distinct[new])
            self.keys = np.insert(self.keys, at, distinct[new])
            self.rows = np.insert(self.rows, at, np.array(rows, np.float32), axis=0)
        return self.rows[np.searchsorted(self.keys, distinct)][inverse], hashes


def features(data, offsets, words):
    """The matrix of texts x FEATURES; a text without words has zeros."""
    n_texts = len(offsets) - 1
    out = np.zeros((n_texts, len(FEATURES)))
    starts, ends, text = textbytes.runs(~textbytes.SPACE[data], offsets)
    if not len(starts):
        return out
    rows, hashes = words.of(data, starts, ends)
    sums = np.stack([np.bincount(text, rows[:, i], n_texts) for i in range(rows.shape[1])], axis=1)
    n_words = np.bincount(text, minlength=n_texts)
    per_word = 1 / np.maximum(n_words, 1)
    hit = np.flatnonzero(rows[:, 1] > 0)
    met = np.unique(np.stack([text[hit].astype(np.uint64), hashes[hit]]), axis=1)[0].astype(np.int64)
    most = np.zeros(n_texts)
    np.maximum.at(most, text[hit], rows[hit, 0])
    # Words of the second person among the neighbours of a hit in its own text.
    before = np.searchsorted(text, np.arange(n_texts + 1))
    seconds = np.concatenate(([0.0], np.cumsum(rows[:, 4])))
    low = np.maximum(hit - NEAR, before[text[hit]])
    high = np.minimum(hit + NEAR + 1, before[text[hit] + 1])
    near = np.bincount(text[hit], seconds[high] > seconds[low], n_texts)
    hits, letters = sums[:, 1], sums[:, 10]
    columns = (
        hits, hits * per_word, np.bincount(met, minlength=n_texts), sums[:, 0] * per_word, most,
        near, near * per_word, sums[:, 4] * per_word, sums[:, 2] * per_word, sums[:, 3],
        sums[:, 5] * per_word, sums[:, 11] / np.maximum(letters, 1), sums[:, 6] * per_word,
        sums[:, 7] * per_word, sums[:, 8] * per_word, sums[:, 9] * per_word,
        np.log1p(n_words), np.log1p(letters),
    )
    for i, column in enumerate(columns):
        out[:, i] = column
    return out


class Trees:
    """Boosted regression trees of a fixed depth for the logarithm of the odds."""

    def __init__(self, n_trees=80, depth=3, rate=0.15, bins=32, least=8.0):
        self.n_trees, self.depth, self.rate, self.bins, self.least = n_trees, depth, rate, bins, least

    def _binned(self, x):
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x, y):
        n, n_features = x.shape
        shares = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], shares)) for j in range(n_features)]
        # Rare values above a common one need a bound of their own.
        self.edges = [
            np.unique(np.append(e, np.quantile(own, shares[::4]) if len(own) else []))
            for e, own in ((e, x[x[:, j] > 0, j] - 1e-12) for j, e in enumerate(self.edges))
        ]
        n_bins = max(len(e) for e in self.edges) + 1
        b = self._binned(x)
        flat = b + np.arange(n_features) * n_bins
        p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p0 / (1 - p0)))
        score = np.full(n, self.start)
        self.trees = []
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-score))
            gradient, curve = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            splits = []
            for level in range(self.depth):
                n_nodes = 1 << level
                at = (node[:, None] * (n_features * n_bins) + flat).ravel()
                shape = (n_nodes, n_features, n_bins)
                g = np.bincount(at, np.repeat(gradient, n_features), np.prod(shape)).reshape(shape)
                h = np.bincount(at, np.repeat(curve, n_features), np.prod(shape)).reshape(shape)
                left_g, left_h = np.cumsum(g, axis=2), np.cumsum(h, axis=2)
                all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
                right_g, right_h = all_g - left_g, all_h - left_h
                gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - all_g**2 / (all_h + 1)
                least = self.least * 0.05
                gain[(left_h < least) | (right_h < least)] = -1
                best = gain.reshape(n_nodes, -1).argmax(axis=1)
                feature, cut = best // n_bins, best % n_bins
                cut = np.where(gain.reshape(n_nodes, -1).max(axis=1) > 1e-9, cut, n_bins)
                splits.append((feature, cut))
                node = 2 * node + (b[np.arange(n), feature[node]] > cut[node])
            g = np.bincount(node, gradient, 1 << self.depth)
            h = np.bincount(node, curve, 1 << self.depth)
            leaf = self.rate * g / (h + 1)
            score += leaf[node]
            self.trees.append((splits, leaf))
        return self

    def score(self, x):
        b = self._binned(x)
        every = np.arange(len(x))
        total = np.full(len(x), self.start)
        for splits, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in splits:
                node = 2 * node + (b[every, feature[node]] > cut[node])
            total += leaf[node]
        return total


def isotonic(score, y):
    """(scores, probabilities): the best non-decreasing steps, by pooling adjacent violators."""
    order = np.argsort(score, kind="stable")
    score, y = score[order], y[order].astype(float)
    blocks = []  # mean, weight, first score, last score
    at = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
    for a, b in zip(at, np.append(at[1:], len(score)), strict=True):
        blocks.append([y[a:b].mean(), b - a, score[a], score[b - 1]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            mean, n, _, last = blocks.pop()
            own = blocks[-1]
            own[0] = (own[0] * own[1] + mean * n) / (own[1] + n)
            own[1], own[3] = own[1] + n, last
    xs = np.array([x for b in blocks for x in (b[2], b[3])])
    ps = np.array([b[0] for b in blocks for _ in (0, 1)])
    return xs, ps


class Classifier:
    def __init__(self, lexicon, x, y, fold):
        """Trees are fitted to two thirds of the rows and calibrated on the others.

        Without rows of both labels, everything gets the share of toxic rows (0 without rows).
        """
        self.lexicon = lexicon
        self.constant = float(y.mean()) if len(y) else 0.0
        self.trees = None
        rest = fold != 0
        if len(set(y[rest])) == 2 and len(set(y[~rest])) == 2:
            self.trees = Trees().fit(x[rest], y[rest])
            self.steps = isotonic(self.trees.score(x[~rest]), y[~rest])

    def probability(self, x):
        if self.trees is None:
            return np.full(len(x), self.constant)
        return np.clip(np.interp(self.trees.score(x), *self.steps), 0.0, 1.0)


def _toxic_grams(rows):
    """(entry, n_toxic, n_clean) of the texts of some batches, added up per batch."""

    def count(batches):
        tokens.forget_encoders()
        textbytes.give_back()
        for part in textbytes.slices(batches, 0, SLICE_BYTES):
            counts = {}
            texts, labels = part.column(0).to_pylist(), part.column(1).to_pylist()
            for text, toxic in zip(texts, labels, strict=True):
                words = {w.lower() for w in _PARTS.findall(text or "")}
                for gram in {g for w in words for g in _grams(w)}:
                    counts.setdefault(gram, [0, 0])[1 - toxic] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(counts), pa.string()),
                    pa.array([c[0] for c in counts.values()], pa.int64()),
                    pa.array([c[1] for c in counts.values()], pa.int64()),
                ],
                ["gram", "n_toxic", "n_clean"],
            )

    return rows.mapInArrow(count, "gram string, n_toxic long, n_clean long")


def learned_lexicon(sample):
    """{entry: weight} from rows (text, toxic); at most LEXICON entries reach the driver.

    An entry's likelihood ratio has to exceed what the best of as many entries would by chance.
    """
    sizes = sample.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in sizes}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return {}
    share = toxic / (toxic + clean)
    counted = _toxic_grams(sample.select("text", "toxic")).groupBy("gram")
    counted = counted.agg(F.sum("n_toxic").alias("t"), F.sum("n_clean").alias("c"))
    met = F.col("t") + F.col("c")

    def term(k, expected):
        return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)

    ratio = 2 * (term(F.col("t"), met * share) + term(F.col("c"), met * (1 - share)))
    told = counted.withColumn("ratio", ratio).filter(
        (F.col("t") >= LEAST_TEXTS) & (F.col("t") > 3 * share * met)
    )
    # Entries met too seldom can't tell anything and aren't counted as tried.
    tried = counted.filter(met >= LEAST_TEXTS).count()
    best = told.filter(F.col("ratio") > 2 * float(np.log(max(tried, 1))) + 10)
    best = best.orderBy(F.desc("ratio"), "gram").limit(LEXICON)
    return {
        r.gram: float(np.log((r.t + 0.5) / toxic) - np.log((r.c + 0.5) / clean)) for r in best.collect()
    }


def _feature_rows(rows, lexicon):
    """Rows (text, toxic, fold) as (toxic, fold, features)."""

    def make(batches):
        tokens.forget_encoders()
        words = Words(lexicon)
        for part in textbytes.slices(batches, 0, SLICE_BYTES):
            x = features(*textbytes.flat(part.column(0)), words)
            ends = np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(1),
                    part.column(2),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel())),
                ],
                ["toxic", "fold", "features"],
            )

    return rows.mapInArrow(make, "toxic int, fold int, features array<double>")


def fit(docs, labels, learn=None, id_col="doc_id", text_col="text"):
    """A classifier from at most SAMPLE_ROWS labelled rows whose id satisfies `learn`.

    `labels` has the id and `toxic`, 0 or 1; rows without either are left out, rows that repeat
    count each time. If ids repeat, the sample can have more documents than labels: the lexicon is
    learned from all of them, the trees from the 2 * SAMPLE_ROWS with the smallest hashes of their
    features, the same ones in every run. Only the features of the sample reach the driver.
    """
    ship(docs.sparkSession)
    own = F.col(id_col)
    marked = labels.select(own.cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.filter("label_id IS NOT NULL AND toxic IS NOT NULL")
    if learn is not None:
        marked = marked.filter(learn(F.col("label_id")))
    order = F.xxhash64("label_id")
    sample = marked.orderBy(order, "label_id", "toxic").limit(SAMPLE_ROWS)
    sample = sample.withColumn("fold", F.pmod(F.xxhash64(F.lit(7), "label_id"), F.lit(3)).cast("int"))
    texts = docs.select(own.cast("long").alias("label_id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), "label_id").select("text", "toxic", "fold")
    lexicon = learned_lexicon(rows)
    # A bounded number of feature vectors; which ones, and their order, doesn't depend on the run.
    vectors = _feature_rows(rows, lexicon)
    vectors = vectors.orderBy(F.xxhash64("features"), "features", "toxic", "fold")
    found = vectors.limit(2 * SAMPLE_ROWS).toPandas()
    x = np.array(found["features"].tolist()).reshape(-1, len(FEATURES))
    y, fold = found["toxic"].to_numpy(), found["fold"].to_numpy()
    order = np.lexsort((*x.T, fold, y))
    return Classifier(lexicon, x[order], y[order].astype(float), fold[order])


def scored(docs, classifier, text_col="text", prefix=""):
    """All columns of `docs` and, under `prefix`, score (0 to 1) and predicted (1: toxic).

    Only the text is looked at; null and empty texts are scored like a text without words. Every
    row is scored on its own. An existing column named like a result is replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    names = [prefix + "score", prefix + "predicted"]
    kept = docs.select([F.col(f"`{c}`") for c in docs.columns if c not in names])
    column, all_names = kept.columns.index(text_col), kept.columns + names
    schema = T.StructType(
        kept.schema.fields
        + [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())]
    )
    shared = spark.sparkContext.broadcast(classifier)

    def score(batches):
        tokens.forget_encoders()
        textbytes.give_back()
        model = shared.value
        words = Words(model.lexicon)
        for part in textbytes.slices(batches, column, SLICE_BYTES):
            p = model.probability(features(*textbytes.flat(part.column(column)), words))
            found = [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(part.columns + found, all_names)
        words = part = found = p = None
        textbytes.give_back()

    return kept.mapInArrow(score, schema)
