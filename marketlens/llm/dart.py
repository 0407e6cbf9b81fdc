"""Near-duplicate documents by DartMinHash: weighted signatures, banded join, exact check.

A text is the weighted set of its shingles, the weight being how often a shingle occurs. Hashing
throws darts at the plane of weight and rank of every shingle: unit cells hold a Poisson number
of darts each, at hashed places. A text keeps the darts below the weights of its shingles, and
its signature holds for each coordinate the earliest of the darts that fall to it. Two texts
agree in a coordinate with the probability of their weighted Jaccard similarity. As only darts
up to a rank of about (coordinates x log coordinates) / weight are looked at, the work hardly
grows with the number of coordinates.
"""

import numpy as np
import pyarrow as pa
from marketlens.llm import textbytes
from marketlens.llm.components import components
from marketlens.llm.decontam import Normalised
from marketlens.llm.runtime import NO_ID, keyed, keyed_rows, ship, stored
from marketlens.llm.textbytes import mixed
from pyspark.sql import Window
from pyspark.sql import functions as F

SHINGLE = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 agrees in all rows of a band with 0.41, in no band with 5e-8.
ROWS = 4
BANDS = 32
#: Darts per coordinate beyond log(coordinates): texts with an empty coordinate throw further.
EXTRA = 2.5
SLICE_BYTES = 1 << 20
#: Cells looked at together.
CELLS = 400_000
#: Texts compared with the same one in a row.
PARTNERS = 1000
#: Texts of a block, where all texts of some buckets are compared.
BLOCK_TEXTS = 400

_U = np.uint64
#: P(X <= k) of a Poisson variable with mean 1, as 32-bit thresholds.
_POISSON = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1), initial=1.0) for k in range(12)])


def shingles(data, offsets, n=SHINGLE):
    """(hash, weight, text) of the distinct shingles of each text, sorted by text and hash.

    Words are lower-case stretches of letters, digits and non-ASCII characters; a text of fewer
    than `n` words, but not none, has one shingle of them all.
    """
    normal = Normalised(data, offsets)
    lower = textbytes.LOWER[data]
    words = textbytes.RangeHash(lower).of(normal.starts, normal.ends)
    before = normal.words_before
    count = np.diff(before)
    n_shingles = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(count)), n_shingles)
    within = np.arange(len(text)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
    first = before[:-1][text] + within
    last = np.minimum(first + n, before[1:][text])
    hashes = textbytes.RangeHash(words).of(first, last)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    begins = np.flatnonzero(new)
    weight = np.diff(np.append(begins, len(hashes)))
    return hashes[begins], weight, text[begins]


def _darts(element, weight, text, low, high, most_rank, coordinates):
    """The darts of some elements in weight units `low` to `high` of every rank unit.

    Returns (coordinate, rank, id, text) of darts below the weight and of rank below most_rank.
    `low`, `high`: which unit of weight and of rank a row stands for.
    """
    cell = mixed(mixed(element + _U(0x9E3779B97F4A7C15) * low.astype(_U)) + _U(0xD1B54A32D192ED03) * high.astype(_U))
    share = (cell >> _U(11)).astype(np.float64) / 2.0**53
    darts = np.searchsorted(_POISSON, share, "right")
    row = np.repeat(np.arange(len(cell)), darts)
    number = np.arange(len(row)) - np.repeat(np.cumsum(darts) - darts, darts)
    name = mixed(cell[row] + _U(0xA0761D6478BD642F) * (number + 1).astype(_U))
    at_weight = low[row] + (mixed(name + _U(1)) >> _U(11)).astype(np.float64) / 2.0**53
    at_rank = high[row] + (mixed(name + _U(2)) >> _U(11)).astype(np.float64) / 2.0**53
    kept = (at_weight < weight[row]) & (at_rank < most_rank[text[row]])
    row, name = row[kept], name[kept]
    coordinate = (mixed(name + _U(3)) % _U(coordinates)).astype(np.int64)
    return coordinate, at_rank[kept], name, text[row]


def _earliest(element, weight, text, from_rank, to_rank, coordinates, n_texts, best_rank, best_name):
    """Update the earliest dart of every coordinate with the ranks from_rank to to_rank, per text."""
    units = np.ceil(weight).astype(np.int64)
    ranks = (np.ceil(to_rank) - np.floor(from_rank)).astype(np.int64)[text]
    cells = units * ranks
    cuts = np.searchsorted(np.cumsum(cells), np.arange(0, int(cells.sum()) + CELLS, CELLS), "left")
    for a, b in zip(cuts, np.append(cuts[1:], len(cells)), strict=True):
        if a == b:
            continue
        row = np.repeat(np.arange(a, b), cells[a:b])
        number = np.arange(len(row)) - np.repeat(np.cumsum(cells[a:b]) - cells[a:b], cells[a:b])
        low = number // ranks[row]
        high = number % ranks[row] + np.floor(from_rank).astype(np.int64)[text[row]]
        place, rank, name, owner = _darts(element[row], weight[row], text[row], low, high, to_rank, coordinates)
        # The earliest comes last, so that it is the one that stays; equal ranks by name.
        slot = owner * coordinates + place
        order = np.lexsort((name, rank, slot))
        slot, rank, name = slot[order], rank[order], name[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        slot, rank, name = slot[first], rank[first], name[first]
        better = rank < best_rank[slot]
        best_rank[slot[better]] = rank[better]
        best_name[slot[better]] = name[better]


def signatures(element, weight, text, n_texts, coordinates):
    """A matrix of texts x coordinates: names of the earliest darts; texts without weight: zeros.

    Weights can be any positive numbers. Texts whose darts leave a coordinate empty throw on,
    to twice the rank each time.
    """
    total = np.bincount(text, weight, n_texts)
    best_rank = np.full(n_texts * coordinates, np.inf)
    best_name = np.zeros(n_texts * coordinates, _U)
    darts = coordinates * (np.log(coordinates) + EXTRA)
    from_rank = np.zeros(n_texts)
    to_rank = np.where(total > 0, darts / np.maximum(total, 1e-300), 0.0)
    todo = total > 0
    while todo.any():
        chosen = todo[text]
        _earliest(
            element[chosen], weight[chosen], text[chosen], from_rank, to_rank, coordinates,
            n_texts, best_rank, best_name,
        )
        empty = np.isinf(best_rank).reshape(n_texts, coordinates).any(axis=1)
        todo &= empty
        # What was cut off inside the last unit of rank is looked at again.
        from_rank = np.where(todo, to_rank, from_rank)
        to_rank = np.where(todo, 2 * to_rank, to_rank)
    return best_name.reshape(n_texts, coordinates)


def band_keys(names, rows=ROWS):
    """A hash for each band of each signature."""
    n, coordinates = names.shape
    sums = np.zeros((n, coordinates // rows), _U)
    for i in range(rows):
        sums = mixed(sums * _U(0x9FB21C651E98DF25) + names[:, i::rows][:, : sums.shape[1]])
    return mixed(sums + np.arange(sums.shape[1], dtype=_U))


def _of_slices(batches, column, limit):
    for part in textbytes.slices(batches, column, limit):
        yield part, *textbytes.flat(part.column(column))


def exact_classes(docs):
    """(doc, twin): every keyed document with the number of the first one with the same words.

    Documents are numbered by what is unique to them, (key, variant) as one column of structs.
    A text without words is only like another one if they are equal as they are.
    """
    ship(docs.sparkSession)

    def digest(batches):
        for part, data, offsets in _of_slices(batches, 2, 4 << 20):
            normal = Normalised(data, offsets)
            lower = textbytes.LOWER[data]
            words = textbytes.RangeHash(lower).of(normal.starts, normal.ends)
            first, last = normal.words_before[:-1], normal.words_before[1:]
            none = first == last
            sums = []
            for kind in (0, 1):
                whole = textbytes.RangeHash(words, kind).of(first, last)
                raw = textbytes.RangeHash(data, kind).of(offsets[:-1], offsets[1:])
                sums.append(np.where(none, mixed(raw + _U(1)), whole).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *map(pa.array, sums)], ["key", "variant", "h1", "h2"]
            )

    hashed = docs.select("key", "variant", "text").mapInArrow(
        digest, "key long, variant long, h1 long, h2 long"
    )
    doc = F.struct("key", "variant")
    hashed = stored(hashed.select(doc.alias("doc"), "h1", "h2"), "text-hashes")
    firsts = hashed.groupBy("h1", "h2").agg(F.min("doc").alias("twin"))
    return hashed.join(firsts, ["h1", "h2"]).select("doc", "twin")


def _band_rows(texts, shingle, rows, bands):
    """(doc, band hash) of the texts that have words."""

    def sign(batches):
        for part, data, offsets in _of_slices(batches, 2, SLICE_BYTES):
            element, weight, text = shingles(data, offsets, shingle)
            names = signatures(element, weight, text, part.num_rows, rows * bands)
            keys = band_keys(names, rows)
            full = np.flatnonzero(np.bincount(text, minlength=part.num_rows))
            owner = pa.array(np.repeat(full, bands))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(owner),
                    part.column(1).take(owner),
                    pa.array(keys[full].ravel().view(np.int64)),
                ],
                ["key", "variant", "band"],
            )

    bands_of = texts.select("key", "variant", "text").mapInArrow(
        sign, "key long, variant long, band long"
    )
    return bands_of.select(F.struct("key", "variant").alias("doc"), "band")


def _similar(pairs, texts, shingle, least):
    """Those of distinct pairs (a, b) whose weighted Jaccard similarity is at least `least`.

    Each text that is asked for is sent once per `a` that it is compared with. The partners of an
    `a` are compared with it one after the other; very many partners are dealt to several groups,
    each with a copy of `a`.
    """
    groups = 1 + F.floor(F.count(F.lit(1)).over(Window.partitionBy("a")) / PARTNERS)
    dealt = pairs.withColumn("group", F.pmod(F.xxhash64("b"), groups))
    members = dealt.select("a", "group", F.lit(1).alias("role"), F.col("b").alias("doc"))
    heads = dealt.select("a", "group").distinct()
    heads = heads.select("a", "group", F.lit(0).alias("role"), F.col("a").alias("doc"))
    named = texts.select(F.struct("key", "variant").alias("doc"), "text")
    # Texts are many and asked ones may be, so both sides are always shuffled.
    asked = members.unionByName(heads).join(named.hint("merge"), "doc").repartition("a", "group")
    near = asked.sortWithinPartitions("a", "group", "role").select("a", "group", "role", "doc", "text")

    def check(batches):
        head = None
        for part, data, offsets in _of_slices(batches, 4, SLICE_BYTES):
            element, weight, text = shingles(data, offsets, shingle)
            ends = np.searchsorted(text, np.arange(part.num_rows + 1))
            roles = part.column(2).to_numpy()
            alike = []
            for i, role in enumerate(roles.tolist()):
                own = element[ends[i] : ends[i + 1]], weight[ends[i] : ends[i + 1]]
                if role == 0:
                    head = own
                elif _alike(head, own, least):
                    alike.append(i)
            which = pa.array(alike, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(which), part.column(3).take(which)], ["a", "b"]
            )

    kind = "struct<key: long, variant: long>"
    return near.mapInArrow(check, f"a {kind}, b {kind}")


def _alike(one, other, least):
    """Whether two sorted weighted sets have a weighted Jaccard similarity of `least` or more."""
    if not len(one[0]) or not len(other[0]):
        return False
    place = np.minimum(np.searchsorted(one[0], other[0]), len(one[0]) - 1)
    both = one[0][place] == other[0]
    shared = np.minimum(one[1][place], other[1])[both].sum()
    either = one[1].sum() + other[1].sum() - shared
    # Without a quotient, so that 0.8 itself counts.
    return bool(shared * 10**6 >= round(least * 10**6) * either)


def near_classes(texts, leaders, shingle=SHINGLE, least=SIMILARITY, rows=ROWS, bands=BANDS):
    """(node, label) of all texts that have a similar one among the `leaders` (doc).

    Texts in the same band bucket are candidates. First every text is compared with the first of
    its buckets, one pair per text and bucket at most. What is then connected needs no further
    comparison; the texts of buckets that still hold several classes are compared across these.
    """
    bucketed = _band_rows(texts, shingle, rows, bands).join(leaders, "doc", "left_semi")
    buckets = stored(bucketed, "bands")
    firsts = buckets.groupBy("band").agg(F.min("doc").alias("a"), F.count(F.lit(1)).alias("n"))
    shared = firsts.filter("n > 1").drop("n")
    pairs = buckets.join(shared, "band").select("a", F.col("doc").alias("b")).filter("a <> b")
    pairs = stored(pairs.distinct(), "pairs")
    links = stored(_similar(pairs, texts, shingle, least), "similar")
    classes = components(links)
    labelled = (
        buckets.join(shared.select("band"), "band")
        .join(classes.withColumnRenamed("node", "doc"), "doc", "left")
        .withColumn("label", F.coalesce("label", "doc"))
    )
    several = (
        labelled.groupBy("band")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"))
        .filter("low <> high")
        .select("band")
    )
    unsettled = stored(labelled.join(several, "band").select("band", "doc", "label"), "unsettled")
    more = stored(_across_classes(unsettled, texts, shingle, least), "similar")
    return classes if more.isEmpty() else components(links.unionByName(more))


def _across_classes(unsettled, texts, shingle, least):
    """Links between different classes, of texts in the same buckets (band, doc, label).

    Buckets that share texts form a group. All texts of a group are compared, in blocks: a task
    gets two blocks of at most about BLOCK_TEXTS texts, adds up what each pair shares over an
    index of shingles, and returns a link for each pair of classes that it finds connected. So
    the rows that are made are texts and links, never pairs to be looked at.
    """
    firsts = unsettled.groupBy("band").agg(F.min("doc").alias("b"))
    edges = unsettled.join(firsts, "band").select(F.col("doc").alias("a"), "b")
    group_of = components(edges).select(F.col("node").alias("doc"), F.col("label").alias("group"))
    members = unsettled.select("doc", "label").distinct().join(group_of, "doc")
    n = F.count(F.lit(1)).over(Window.partitionBy("group"))
    blocks = members.withColumn("blocks", (1 + F.floor((n - 1) / BLOCK_TEXTS)).cast("int"))
    dealt = blocks.withColumn("own", F.pmod(F.xxhash64("doc"), "blocks").cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    # Groups that meet in a task by chance would only be compared for nothing.
    task = F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other"))
    asked = dealt.select(task.alias("task"), "own", (F.col("own") == F.col("other")).alias("alone"), "label", "doc")
    named = texts.select(F.struct("key", "variant").alias("doc"), "text")
    near = (
        asked.join(named.hint("merge"), "doc")
        .select("task", "own", "alone", "label.key", "label.variant", "doc", "text")
        .repartition("task")
        .sortWithinPartitions("task")
    )

    def compare(batches):
        for rows in _tasks(batches):
            one, other = _linked(rows, shingle, least)
            docs = rows.column(5)
            yield pa.RecordBatch.from_arrays(
                [docs.take(pa.array(one)).combine_chunks(), docs.take(pa.array(other)).combine_chunks()],
                ["a", "b"],
            )

    kind = "struct<key: long, variant: long>"
    return near.mapInArrow(compare, f"a {kind}, b {kind}")


def _tasks(batches):
    """Tables of the rows of one task each, of batches sorted by task."""
    held = []
    for batch in batches:
        table = pa.Table.from_batches([*held, batch])
        task = table.column(0).to_numpy()
        cuts = np.flatnonzero(task[1:] != task[:-1]) + 1
        for a, b in zip(np.append(0, cuts), cuts, strict=False):
            yield table.slice(a, b - a)
        held = table.slice(cuts[-1] if len(cuts) else 0).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _linked(rows, shingle, least):
    """Rows (one, other) of a task whose texts are alike, one pair for two classes at most."""
    own, alone = rows.column(1).to_numpy(), rows.column(2).to_numpy()[0]
    _, label = np.unique(
        np.stack([rows.column(i).to_numpy() for i in (3, 4)]), axis=1, return_inverse=True
    )
    units, texts, at = [], [], 0
    for batch in rows.to_batches():
        for part, data, offsets in _of_slices([batch], 6, SLICE_BYTES):
            element, weight, text = shingles(data, offsets, shingle)
            # A shingle that occurs k times is k things to share.
            number = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
            units.append(mixed(np.repeat(element, weight) + _U(0x9FB21C651E98DF25) * number.astype(_U)))
            texts.append(at + np.repeat(text, weight))
            at += part.num_rows
    unit, text = np.concatenate(units), np.concatenate(texts)
    size = np.bincount(text, minlength=at)
    order = np.lexsort((text, unit))
    unit, text = unit[order], text[order]
    shared = np.zeros(at * at, np.int32)
    # Two texts of the largest class need no comparison: pairs begin at texts of other classes.
    # Occurrences of a shingle that are `step` places apart, for all shingles at once; backwards
    # only to texts of the largest class, as others come this way themselves.
    largest = label == np.bincount(label).argmax()
    begin = np.flatnonzero(~largest[text])
    for back in (False, True):
        rest, step = begin, 1
        while len(rest):
            partner = rest - step if back else rest + step
            inside = partner >= 0 if back else partner < len(unit)
            rest, partner = rest[inside], partner[inside]
            same = unit[rest] == unit[partner]
            rest, partner = rest[same], partner[same]
            if back:
                hit = largest[text[partner]]
                np.add.at(shared, text[partner[hit]] * at + text[rest[hit]], 1)
            else:
                np.add.at(shared, text[rest] * at + text[partner], 1)
            step += 1
    one, other = np.divmod(np.flatnonzero(shared), at)
    both = shared[one * at + other]
    either = size[one] + size[other] - both
    alike = (both * 10**6 >= round(least * 10**6) * either) & (label[one] != label[other])
    if not alone:
        alike &= own[one] != own[other]
    one, other = one[alike], other[alike]
    classes = np.sort(np.stack([label[one], label[other]]), axis=0)
    _, first = np.unique(classes, axis=1, return_index=True)
    return one[first], other[first]


def near_duplicates(docs, id_col="doc_id", text_col="text", shingle=SHINGLE, least=SIMILARITY):
    """Per row: doc_id, class_id and twin_id.

    twin_id is the smallest id with the same words; class_id the smallest id that the document is
    connected with by texts of similarity `least` or more (weighted Jaccard similarity of word
    shingles). Ids stand for rows; rows that repeat an id with another text are documents of
    their own, a row without id comes after all others and can have a null class_id. Texts
    without words, null among them, are only like equal ones.
    """
    classes = document_classes(keyed(docs, id_col, text_col), shingle, least)

    def shown(column):
        return F.when(F.col(f"{column}.key") != NO_ID, F.col(f"{column}.key"))

    return classes.select(
        shown("doc").alias("doc_id"), shown("label").alias("class_id"), shown("twin").alias("twin_id")
    )


def document_classes(named, shingle=SHINGLE, least=SIMILARITY):
    """(doc, twin, label) as structs of key and variant, for every row of keyed documents."""
    twins = stored(exact_classes(named), "twins")
    leaders = twins.filter("doc = twin").select("doc").distinct()
    classes = near_classes(named, leaders, shingle, least)
    labels = classes.select(F.col("node").alias("twin"), "label")
    return twins.join(labels, "twin", "left").select(
        "doc", "twin", F.coalesce("label", "twin").alias("label")
    )


def one_of_each_class(docs, id_col="doc_id", text_col="text", shingle=SHINGLE, least=SIMILARITY):
    """The rows of `docs`, all columns, of the first document of each class; see near_duplicates.

    A row that is repeated whole stays once.
    """
    rows, repeated = keyed_rows(docs, id_col, text_col)
    classes = document_classes(rows.drop("row"), shingle, least)
    first = classes.filter("doc = label").select("doc.key", "doc.variant").distinct()
    kept = rows.join(first, ["key", "variant"], "left_semi")
    if repeated:
        kept = kept.dropDuplicates(["key", "variant"])
    return kept.select([F.col("row").getField(c).alias(c) for c in docs.columns])
