"""Texts of an Arrow batch as one byte array: slices, words, and hashes of byte ranges.

All functions take whole arrays; nothing loops over characters or words in Python.
"""

import numpy as np
import pyarrow as pa

#: ASCII white space: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in lower-cased text.
LETTER = np.zeros(256, bool)
LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_VALUES = np.random.default_rng(20240501).integers(1, 2**64, (2, 256), np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def slices(batches, column, limit):
    """Parts of record batches whose texts have at most `limit` bytes, a single longer text aside."""
    for batch in batches:
        sizes = np.diff(flat(batch.column(column))[1])
        begin, held = 0, 0
        for i in np.arange(len(sizes)):
            if held and held + sizes[i] > limit:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += sizes[i]
        if batch.num_rows > begin:
            yield batch.slice(begin)


def give_back():
    """Give memory that a reused worker no longer needs back to the system, where the system can."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    # Only glibc has this.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def flat(column):
    """(bytes, offsets) of a string column, null as empty; the bytes aren't copied."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(inside, offsets):
    """Starts and ends of the runs of True that don't cross a text, and the text of each run."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    begins, ends = offsets[:-1][full], offsets[1:][full] - 1
    first[begins] = inside[begins]
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    text = np.searchsorted(offsets, starts, "right") - 1
    return starts, np.flatnonzero(last) + 1, text


def mixed(x):
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n):
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            grown = np.full(max(n, 1 << 20), base)
            grown[0] = 1
            _powers[i] = np.cumprod(grown)
    return _powers[0][:n], _powers[1][:n]


class RangeHash:
    """64-bit hashes of any ranges of a sequence, each in constant time; two kinds, for 128 bits."""

    def __init__(self, values, kind=0):
        if values.dtype == np.uint8:
            values = _VALUES[kind][values]
        elif kind:
            values = mixed(values + np.uint64(0x632BE59BD9B4E019))
        forward, self.back = _power(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * forward[:-1], out=self.sums[1:])

    def of(self, starts, ends):
        sums = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mixed(sums + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gather(flat_values, at, sizes):
    """The concatenation of flat_values[at[i] : at[i] + sizes[i]]."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    index = np.repeat(at - (ends - sizes), sizes)
    index += np.arange(total)
    return flat_values[index]
