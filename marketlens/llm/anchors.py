"""Candidate search for repeated windows of a fixed number of symbols (bytes or words).

Each window has one anchor: its smallest hashed gram. Equal windows have equal anchors at equal
places, so a window can only be repeated if its anchor is. The windows with the same anchor
occurrence are neighbours; together they are a region, and every window lies in exactly one.
Regions are grouped by anchor:

* equal regions are settled by their first occurrence,
* an anchor with a single region holds nothing repeated,
* what is left, different regions with the same anchor, is cut out of the texts and compared by
  the operator that calls: by suffix arrays or by an index with backward search.

Hashes of regions have 128 bits together with their anchor's; nothing else is left to chance.
"""

import numpy as np
import pyarrow as pa
from marketlens.llm import suffixes, textbytes
from marketlens.llm.runtime import ship
from marketlens.llm.textbytes import RangeHash, mixed
from pyspark.sql import Window
from pyspark.sql import functions as F

#: Regions of an anchor are compared in shards of about so many, with about so many symbols at
#: most. A shard is one suffix array: the rest up to suffixes.MOST is for uneven shards.
SHARD_REGIONS = 20_000
SHARD_SYMBOLS = suffixes.MOST * 3 // 4
SLICE_BYTES = 2 << 20

#: kind 0: a region to be grouped; kind 1: a stretch known to be repeated.
FOUND = (
    "anchor long, region long, key long, variant long, start int, size int, place int, "
    "kind byte, several boolean"
)
COVERED = "key long, variant long, start int, size int"

_PLACE = np.uint64((1 << 31) - 1)


def regions(grams, offsets, window, gram):
    """(anchor position, first window, last window) of all regions of the texts.

    `grams`: a hash for each position, of the `gram` symbols from there on; only those of whole
    windows inside a text are used. `offsets`: where texts begin, with the end.
    """
    n = int(offsets[-1])
    empty = np.empty(0, np.int64)
    if n < window:
        return empty, empty, empty
    width = window - gram + 1
    place = np.arange(n - gram + 1, dtype=np.uint64)
    least = (mixed(grams[: n - gram + 1]) & ~_PLACE) | place
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    # Windows that end inside their own text.
    text = np.searchsorted(offsets, np.arange(len(least)), "right") - 1
    inside = np.flatnonzero(np.arange(len(least)) + window <= offsets[text + 1])
    if not len(inside):
        return empty, empty, empty
    position = (least[inside] & _PLACE).astype(np.int64)
    new = np.ones(len(inside), bool)
    new[1:] = (position[1:] != position[:-1]) | (inside[1:] != inside[:-1] + 1)
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(inside)) - 1
    return position[begins], inside[begins], inside[ends]


def first_of_runs(*sorted_keys):
    """True where a row of the sorted columns differs from the row before."""
    new = np.ones(len(sorted_keys[0]), bool)
    if len(new) > 1:
        new[1:] = False
        for column in sorted_keys:
            new[1:] |= column[1:] != column[:-1]
    return new


def region_rows(values, grams, offsets, window, gram, key, variant, keep_first):
    """Rows of FOUND for one slice of texts; regions that repeat inside it are settled at once.

    `values` are symbols for hashing whole regions; `key` and `variant` name the texts.
    keep_first: the first occurrence of a repeated region isn't covered by the others.
    """
    position, first, last = regions(grams, offsets, window, gram)
    if not len(position):
        return None
    end = last + window
    anchor = mixed(grams[position] + np.uint64(0x5851F42D4C957F2D)).view(np.int64)
    place = position - first
    region = RangeHash(values, 1).of(first, end) + place.astype(np.uint64)
    region = mixed(region).view(np.int64)
    text = np.searchsorted(offsets, first, "right") - 1
    start = first - offsets[text]
    rows = [anchor, region, key[text], variant[text], start, end - first, place]
    order = np.lexsort((start, rows[3], rows[2], region, anchor))
    rows = [x[order] for x in rows]
    # A document given twice is one document: its rows aren't copies of each other.
    once = first_of_runs(*rows[:5])
    rows = [x[once] for x in rows]
    new = first_of_runs(rows[0], rows[1])
    several = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
    covered = several & ~new if keep_first else several
    grouped = np.flatnonzero(new)
    settled = np.flatnonzero(covered)
    out = [np.concatenate((x[grouped], x[settled])) for x in rows]
    kind = np.repeat(np.array([0, 1], np.int8), [len(grouped), len(settled)])
    flags = np.concatenate((several[grouped], np.zeros(len(settled), bool)))
    # Settled stretches need no grouping: any spread will do.
    out[0][len(grouped) :] = mixed(np.arange(len(settled), dtype=np.uint64) + np.uint64(
        out[2][0] & 0x7FFFFFFF)).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in out[:4]]
        + [pa.array(x, pa.int32()) for x in out[4:7]]
        + [pa.array(kind), pa.array(flags)],
        ["anchor", "region", "key", "variant", "start", "size", "place", "kind", "several"],
    )


def found_regions(keyed_docs, symbols, window, gram, keep_first):
    """FOUND rows of all texts. `symbols(data, offsets)` returns (values, grams, offsets)."""
    ship(keyed_docs.sparkSession)

    def find(batches):
        for part in textbytes.slices(batches, 2, SLICE_BYTES):
            names = [part.column(i).to_numpy() for i in (0, 1)]
            values, grams, offsets = symbols(*textbytes.flat(part.column(2)))
            rows = region_rows(values, grams, offsets, window, gram, *names, keep_first)
            if rows is not None:
                yield rows

    return keyed_docs.select("key", "variant", "text").mapInArrow(find, FOUND)




def settled_regions(found, keep_first):
    """Group regions by anchor: kind 1, covered stretches; kind 2, regions to be compared.

    One shuffle by anchor, in which a region has at most one row per slice, as slices settle
    their own copies. keep_first: later occurrences are covered; otherwise all of several.
    An anchor with very many different regions, or long ones, has them dealt to `shards` shards.
    """
    name = F.struct("key", "variant", "start")
    same = Window.partitionBy("anchor", "region").orderBy("key", "variant", "start")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    group = Window.partitionBy("anchor")
    # One exchange by anchor serves both kinds of windows.
    regions_before = (
        found.repartition("anchor")
        .withColumn("number", F.row_number().over(same))
        .withColumn("leader", F.first(name).over(whole))
        .withColumn("trailer", F.last(name).over(whole))
        .withColumn("new", ((F.col("kind") == 0) & (F.col("number") == 1)).cast("long"))
        .withColumn("n_regions", F.sum("new").over(group))
        # With one symbol more for what parts a region from the next one.
        .withColumn("n_symbols", F.sum(F.col("new") * (F.col("size") + 1)).over(group))
    )
    if keep_first:
        covered = name != F.col("leader")
    else:
        covered = (F.col("leader") != F.col("trailer")) & ~F.col("several")
    settled = F.col("kind") == 1
    compared = ~settled & (F.col("new") == 1) & (F.col("n_regions") > 1)
    shards = F.greatest(
        1 + F.floor(F.col("n_regions") / F.lit(SHARD_REGIONS)),
        1 + F.floor(F.col("n_symbols") / F.lit(SHARD_SYMBOLS)),
    ).cast("int")
    marks = regions_before.select(
        "anchor",
        shards.alias("shards"),
        F.pmod("region", shards).cast("int").alias("shard"),
        "key",
        "variant",
        "start",
        "size",
        "place",
        (settled | covered).alias("covered"),
        (settled | covered | F.col("several")).alias("done"),
        compared.alias("compared"),
    )
    return marks.filter("covered OR compared")


def cut_out(settled, keyed_docs, cut, piece_type):
    """The compared regions with their symbols as column `piece`, from one join with the texts.

    `cut(data, offsets, text, starts, sizes)` returns the pieces of regions in some texts.
    """
    wanted = (
        settled.filter("compared")
        .groupBy("key", "variant")
        .agg(F.collect_list(F.struct("anchor", "shards", "shard", "start", "size", "done")).alias("parts"))
    )
    texts = keyed_docs.select("key", "variant", "text")
    joined = wanted.join(texts, ["key", "variant"]).select("key", "variant", "text", "parts")

    def split(batches):
        for part in textbytes.slices(batches, 2, SLICE_BYTES):
            lists = part.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            fields = lists.flatten()
            anchor, shards, shard, start, size = (fields.field(i).to_numpy() for i in range(5))
            pieces = cut(*textbytes.flat(part.column(2)), row, start.astype(np.int64), size.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor),
                    pa.array(shards),
                    pa.array(shard),
                    part.column(0).take(pa.array(row)),
                    part.column(1).take(pa.array(row)),
                    pa.array(start),
                    pa.array(size),
                    pieces,
                    fields.field(5),
                ],
                ["anchor", "shards", "shard", "key", "variant", "start", "size", "piece", "done"],
            )

    return joined.mapInArrow(split, f"{CUT} {piece_type}, done boolean")


CUT = "anchor long, shards int, shard int, key long, variant long, start int, size int, piece"


def compared_in_blocks(cut, compare, schema, most_symbols):
    """Apply `compare` to blocks of whole shards, each with at most about `most_symbols` symbols.

    `compare(batch)` gets the rows of a block, sorted by anchor, shard and place in the documents,
    and returns a record batch or None.
    """
    near = cut.repartition("anchor", "shard").sortWithinPartitions(
        "anchor", "shard", "key", "variant", "start"
    )

    def work(batches):
        held, n_held = [], 0
        for batch in batches:
            held.append(batch)
            n_held += _symbols(batch)
            if n_held >= most_symbols:
                table = pa.Table.from_batches(held).combine_chunks()
                anchor = table.column(0).to_numpy()
                shard = table.column(2).to_numpy()
                last = np.flatnonzero(first_of_runs(anchor, shard))[-1]
                if last:
                    yield from _blocks(table.slice(0, last), compare, most_symbols)
                    table = table.slice(last)
                held = table.to_batches()
                n_held = sum(map(_symbols, held))
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from _blocks(table, compare, most_symbols)

    return near.mapInArrow(work, schema)


def _symbols(batch):
    return int(batch.column(6).to_numpy().astype(np.int64).sum())


def _blocks(table, compare, most_symbols):
    if not table.num_rows:
        return
    # A document given twice has been cut twice.
    names = [table.column(i).to_numpy() for i in (0, 2, 3, 4, 5)]
    once = first_of_runs(*names)
    if not once.all():
        table = table.filter(pa.array(once))
    anchor, shard = (x[once] for x in names[:2])
    begins = np.flatnonzero(first_of_runs(anchor, shard))
    ends = np.append(begins[1:], table.num_rows)
    symbols = np.concatenate(([0], np.cumsum(table.column(6).to_numpy().astype(np.int64))))
    at = 0
    while at < len(begins):
        # As many shards as fit, one at least.
        to = int(np.searchsorted(symbols[ends], symbols[begins[at]] + most_symbols, "right"))
        to = max(to, at + 1)
        part = table.slice(begins[at], ends[to - 1] - begins[at]).combine_chunks()
        result = compare(part.to_batches()[0])
        if result is not None and result.num_rows:
            yield result
        at = to


def per_document(covered):
    """Covered stretches (key, variant, start, size) as two arrays per document."""
    return covered.groupBy("key", "variant").agg(
        F.collect_list(F.struct("start", "size")).alias("stretches")
    )


def covered_positions(n, starts, sizes):
    """True for each of n positions that a stretch covers."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + sizes, -1)
    return np.cumsum(depth[:-1]) > 0
