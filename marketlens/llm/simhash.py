"""Near duplicates by SimHash fingerprints that differ in few bits.

A fingerprint has the bits that are set in more than half of the hashes of a text's shingles. Two
of them that differ in at most MOST bits agree in one of MOST + 1 blocks of bits. So each goes, per
block, to the group of those that agree with it there, whole groups in Gray order to a task, and
there an index (`grayindex`) finds the links. A group that is too large is dealt further: within
it the remaining bits are cut into blocks in the same way. A task returns, for all it has linked,
one link each to the first of them; the components of these links are those of all links.
"""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from marketlens.llm import grayindex
from marketlens.llm.components import components
from marketlens.llm.runtime import ship, stored

SEED, SHINGLE, MOST = 42, 3, 3
#: Fingerprints of a group that go to one task; no group is larger after DEPTH cuts than it may be.
GROUP, DEPTH = 50_000, 4
#: Fingerprints that a task indexes together, and bytes of a text that are cut into words at a time.
TOGETHER, PIECE = 400_000, 1 << 20
_WHITE = re.compile(rb"[\t-\r ]")


def _pieces(text):
    """The words of a text as lists, without taking all of a long text apart at once."""
    data = text.encode().lower()
    begin = 0
    while begin < len(data):
        cut = _WHITE.search(data, begin + PIECE)
        end = cut.start() if cut else len(data)
        # Bytes are split at the six white characters of ASCII and no others.
        yield data[begin:end].split()
        begin = end


def _bit_counts(words):
    """How many shingles of some words have each bit set, and how many there are."""
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(SHINGLE, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    hashes = [
        xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())
    ]
    octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64), len(hashes)


def fingerprint(text):
    """The fingerprint of a text as an unsigned number; 0 without words."""
    counts, n, held = np.zeros(64, np.int64), 0, []
    for words in _pieces(text or ""):
        held += words
        if len(held) >= SHINGLE:
            more, k = _bit_counts(held)
            counts, n, held = counts + more, n + k, held[-(SHINGLE - 1) :]
    if held and not n:
        counts, n = _bit_counts(held)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _with_fingerprints(batches):
    for batch in batches:
        codes = [fingerprint(text.as_py()) for text in batch.column("text")]
        codes = pa.array(np.array(codes, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), codes], ["doc_id", "code"])


def fingerprints(docs, id_col="doc_id", text_col="text"):
    """Rows (doc_id, code), one per row of `docs`; `code` is the fingerprint as a signed number."""
    ship(docs.sparkSession)
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )
    return rows.mapInArrow(_with_fingerprints, "doc_id bigint, code bigint")


def _cuts(n_bits, parts):
    """Widths of blocks of bits, the wider ones first."""
    return [n_bits // parts + (i < n_bits % parts) for i in range(parts)]


def _dealt(rows, parts, numbers):
    """Rows (code, turned, free, way) per block: the block is brought in front of the free bits.

    `turned` is the code with the bits that its group shares in front, `free` the number of the
    others, one of `numbers`; `way` names the blocks in front. Also returned: the new numbers.
    """
    dealt, left = None, set()
    for free in numbers:
        offset = 0
        for width in _cuts(free, parts):
            low_bits = F.lit(-1 if free == 64 else (1 << free) - 1)
            low = F.col("turned").bitwiseAND(low_bits)
            high = F.col("turned").bitwiseAND(F.bitwise_not(low_bits))
            front = F.shiftleft(low, offset).bitwiseAND(low_bits)
            back = F.shiftrightunsigned(low, free - offset) if offset else F.lit(0).cast("long")
            one = rows.filter(F.col("free") == free).select(
                "code",
                high.bitwiseOR(front).bitwiseOR(back).alias("turned"),
                F.lit(free - width).alias("free"),
                F.concat("way", F.lit(f"{offset}/")).alias("way"),
            )
            dealt = one if dealt is None else dealt.unionByName(one)
            offset += width
            left.add(free - width)
    return dealt, sorted(left)


def _shared(turned, free):
    """The bits that a group shares, as one number."""
    return F.expr(f"shiftrightunsigned({turned}, {free})")


def _gray_order(turned):
    rank = turned
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank


def _links_of_task(most):
    def link(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= TOGETHER:
                table = pa.Table.from_batches(held).combine_chunks()
                # Up to where the last group begins; that group may go on.
                end = _last_begin(table)
                if end:
                    yield from _links(table.slice(0, end), most)
                    held, n = table.slice(end).to_batches(), table.num_rows - end
        if n:
            yield from _links(pa.Table.from_batches(held), most)

    return link


def _group_of(table):
    free = table["free"].to_numpy().astype(np.uint64)
    turned = table["turned"].to_numpy().view(np.uint64)
    return turned >> free, free, turned


def _last_begin(table):
    shared, _, _ = _group_of(table)
    ways = np.asarray(table["way"].to_pylist())
    other = np.flatnonzero((shared != shared[-1]) | (ways != ways[-1]))
    return int(other[-1]) + 1 if len(other) else 0


def _links(table, most):
    """Links from fingerprints to the first of their component, by way."""
    shared, free, turned = _group_of(table)
    code = table["code"].to_numpy()
    ways = np.asarray(table["way"].to_pylist())
    borders = np.flatnonzero(ways[1:] != ways[:-1]) + 1
    for part in np.split(np.arange(len(ways)), borders):
        if not len(part):
            continue
        fixed = int(grayindex.ALL) ^ ((1 << int(free[part[0]])) - 1)
        labels = grayindex.components(turned[part], most, fixed)
        linked = np.flatnonzero(labels != np.arange(len(labels)))
        a, b = code[part[linked]], code[part[labels[linked]]]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def links(codes, most=MOST, group=GROUP):
    """Links (a, b) between distinct `code`s; their components are those of all codes that
    differ in at most `most` bits. Every code is in few links, whatever the size of a group.
    """
    ship(codes.sparkSession)
    parts = most + 1
    whole = codes.select("code", F.col("code").alias("turned"), F.lit(64).alias("free"), F.lit("").alias("way"))
    rows, numbers = _dealt(whole, parts, [64])
    small = None
    for depth in range(DEPTH):
        rows = stored(rows.withColumn("shared", _shared("turned", "free")), "simhash-groups")
        sizes = rows.groupBy("way", "shared").agg(F.count(F.lit(1)).alias("n"))
        large = sizes.filter(F.col("n") > group).select("way", "shared")
        last = depth == DEPTH - 1 or large.isEmpty()
        here = rows if last else rows.join(large, ["way", "shared"], "left_anti")
        here = here.select("way", "shared", "code", "turned", "free")
        small = here if small is None else small.unionByName(here)
        if last:
            break
        rows = rows.join(large, ["way", "shared"], "left_semi").drop("shared")
        rows, numbers = _dealt(rows, parts, numbers)
    # Whole groups to a task: the rank of what a group shares is the front of its members' ranks.
    ranked = small.withColumn("group", _gray_order(F.col("shared"))).withColumn(
        "rank", _gray_order(F.col("turned")).bitwiseXOR(F.lit(-(2**63)))
    )
    placed = ranked.repartitionByRange("way", "group").sortWithinPartitions("way", "rank")
    return placed.select("way", "code", "turned", "free").mapInArrow(
        _links_of_task(most), "a bigint, b bigint"
    )


def near_duplicates(docs, id_col="doc_id", text_col="text", most=MOST, group=GROUP):
    """Per row: doc_id, fingerprint (16 hexadecimal digits) and component_id.

    Words are what stands between ASCII white space, A-Z in lower case; a shingle is SHINGLE words
    joined by one space, each counted as often as it occurs, or all words of a text with fewer.
    A null or empty text has no words and the fingerprint zero, which is linked like any other.
    The component of a document is that of its fingerprint, component_id the smallest id in it;
    it is null if none of its rows has an id. Rows that repeat, with their id or without one, give a
    row each. Other columns are ignored; an empty table gives no rows.
    """
    prints = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    codes = stored(prints.groupBy("code").agg(F.min("doc_id").alias("first_id")), "codes")
    found = components(links(codes, most, group))
    named = codes.join(found.withColumnRenamed("node", "code"), "code", "left")
    named = stored(named.withColumn("label", F.coalesce("label", "code")), "code-labels")
    firsts = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    ids = named.join(firsts, "label").select("code", "component_id")
    return prints.join(ids, "code").select(
        "doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id"
    )
