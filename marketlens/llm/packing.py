"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Only the histogram of piece lengths matters for a packing, and it has at most as many entries as
a sequence has tokens. The plan is made for it alone: a reduction in the manner of Martello and
Toth fixes small sets that dominate all other sets with the same largest piece, then the rest is
packed by best fit, always for all equal pieces and equal sequences at once. The plan says which
places a length gets; the k-th piece of a length takes the k-th place.
"""

import zlib

import numpy as np
import pyarrow as pa
from marketlens.llm import textbytes, tokens
from marketlens.llm.runtime import ship, stored
from pyspark.sql import Window
from pyspark.sql import functions as F

CAPACITY = 2048
SLICE_BYTES = 4 << 20
#: Pieces of one length are numbered in groups of about so many.
GROUP_PIECES = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def reduced(counts, capacity):
    """(fixed sets as {lengths: times}, counts left). `counts`: {length: number}.

    For the largest piece j left: alone if nothing fits beside it; with the largest piece k that
    fits, if they fill the sequence or if no two pieces fit beside j. Any other set with j can
    exchange what it has beside j for k, so some best packing has the fixed set.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    fixed = {}

    def fix(n, *lengths):
        fixed[lengths] = fixed.get(lengths, 0) + n
        for x in lengths:
            left[x] -= n

    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while left[j]:
                room = capacity - j
                own = left[j]
                fitting = np.flatnonzero(left[1 : room + 1]) + 1
                if len(fitting) and fitting[-1] == j and own == 1:
                    fitting = fitting[:-1]
                if not len(fitting):
                    fix(own, j) if j > room else fix(1, j)
                    changed = True
                    continue
                k = int(fitting[-1])
                smallest = int(fitting[0])
                second = smallest if left[smallest] - (smallest == j) > 1 else None
                if second is None:
                    second = int(fitting[1]) if len(fitting) > 1 else None
                if k != room and second is not None and smallest + second <= room:
                    break
                n = own // 2 if k == j else min(own, left[k])
                fix(max(int(n), 1), j, k)
                changed = True
    return fixed, {int(x): int(left[x]) for x in np.flatnonzero(left)}


def best_fit(counts, capacity):
    """Best-fit decreasing of {length: number}: {lengths in a sequence: times}.

    A group is a number of sequences with the same content. Equal pieces go to the fullest
    sequences that have room, and a sequence takes as many as fit before the next one is begun.
    """
    by_room = {}  # room -> {content as tuple of (length, times): number of sequences}
    for length in sorted(counts, reverse=True):
        n = counts[length]
        rooms = sorted(room for room in by_room if room >= length)
        for room in rooms:
            if not n:
                break
            for content in list(by_room[room]):
                if not n:
                    break
                n = _fill(by_room, room, content, length, n)
        if n:
            by_room.setdefault(capacity, {})[()] = -(-n // (capacity // length))
            _fill(by_room, capacity, (), length, n)
    packed = {}
    for groups in by_room.values():
        for content, times in groups.items():
            lengths = tuple(x for x, k in content for _ in range(k))
            packed[lengths] = packed.get(lengths, 0) + times
    return packed


def _fill(by_room, room, content, length, n):
    """Put up to n equal pieces into the sequences of a group; returns how many are left."""
    each = room // length
    times = by_room[room].pop(content)
    if not by_room[room]:
        del by_room[room]
    full = min(times, n // each)

    def put(k, number):
        if number:
            new = content + ((length, k),) if k else content
            groups = by_room.setdefault(room - k * length, {})
            groups[new] = groups.get(new, 0) + number

    put(each, full)
    n, times = n - full * each, times - full
    if n and times:
        put(n, 1)
        n, times = 0, times - 1
    put(0, times)
    return n


def plan(counts, capacity=CAPACITY):
    """Where the pieces of each length go, for {length: number}.

    Arrays sorted by length and rank: pieces of `length` with a rank of `rank` to `rank + times`
    go to sequences from `sequence` on, one each, all at `offset`.
    """
    fixed, left = reduced(counts, capacity)
    sets = [*fixed.items(), *best_fit(left, capacity).items()]
    next_rank, sequence, rows = {}, 0, []
    for lengths, times in sets:
        offset = 0
        for length in lengths:
            rank = next_rank.get(length, 0)
            rows.append((length, rank, sequence, offset))
            next_rank[length] = rank + times
            offset += length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}, sequence


def pieces(docs, tokenizer_path, end_id=0, capacity=CAPACITY):
    """Tokenise: a row per piece with its length and the CRC-32 of its ids.

    A document is its ids and `end_id`; null and empty texts are that id alone. Longer documents
    than `capacity` are cut into pieces of that size, of which the first may be shorter.
    Repeated rows and ids give pieces each time; a null doc_id stays null.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))

    def cut(batches):
        coder = tokens.encoder(tokenizer_path)
        for part in textbytes.slices(batches, 1, SLICE_BYTES):
            ids, before = coder.encode(*textbytes.flat(part.column(1)))
            ids, before = tokens.with_end(ids, before, end_id)
            n = np.diff(before)
            parts = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), parts)
            number = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            first = n - (parts - 1) * capacity
            start = np.where(number == 0, 0, first[row] + (number - 1) * capacity)
            length = np.where(number == 0, first[row], capacity)
            wide = memoryview(ids.astype("<u4")).cast("B")
            at = (before[row] + start).tolist()
            crc = [zlib.crc32(wide[4 * a : 4 * (a + k)]) for a, k in zip(at, length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(row)),
                    pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return rows.mapInArrow(cut, PIECES)


def placed(pieces_table, capacity=CAPACITY):
    """Add sequence_id and offset to stored pieces (column `length`, 1 to capacity).

    To the driver go one count per length, at most `capacity` of them; the plan that goes back has
    a size that depends on the lengths and not on the number of pieces.
    """
    spark = pieces_table.sparkSession
    counts = {r["length"]: r["count"] for r in pieces_table.groupBy("length").count().collect()}
    places, _ = plan(counts, capacity)
    groups = 1 + max(counts.values(), default=0) // GROUP_PIECES
    salted = pieces_table.withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int")
    )
    # Numbers within a length: those of its earlier groups, then the place in the own group.
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("salt")
    bases = sizes.withColumn("base", F.sum("n").over(earlier) - F.col("n")).drop("n")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = (
        salted.withColumn("place", F.row_number().over(within) - 1)
        .join(F.broadcast(bases) if groups == 1 else bases, ["length", "salt"])
        .withColumn("rank", F.col("base") + F.col("place"))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    )
    shared = spark.sparkContext.broadcast(places)

    def place(batches):
        known = shared.value
        # Length and rank as one sorted number.
        span = np.int64(2**50)
        keys = known["length"] * span + known["rank"]
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            run = np.searchsorted(keys, length * span + rank, "right") - 1
            sequence = known["sequence"][run] + rank - known["rank"][run]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(known["offset"][run])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack(docs, tokenizer_path, end_id=0, capacity=CAPACITY):
    """Tokenise, cut and pack all documents; a row per piece with its place in a sequence."""
    return placed(stored(pieces(docs, tokenizer_path, end_id, capacity), "pieces"), capacity)
