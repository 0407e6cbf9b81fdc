"""Suffix arrays by refinement of groups in the manner of Larsson and Sadakane, and Kasai's
common prefixes, both as whole-array operations."""

import numpy as np

#: Sorting packs a group, a rank and a position into one 63-bit number.
MOST = (1 << 21) - 1
_BITS = np.int64(21)
_MASK = np.int64(MOST)


def suffix_array(symbols):
    """Positions in the order of their suffixes. symbols: integers from 0 to below 2**20; at most
    MOST of them. A suffix that is a prefix of another one comes first."""
    n = len(symbols)
    if n > MOST:
        raise ValueError("Too many symbols for one suffix array.")
    place = np.arange(n, dtype=np.int64)
    symbols = symbols.astype(np.int64) + 1
    # As many symbols as fit beside a position.
    bits = max(int(symbols.max(initial=1)).bit_length(), 1)
    h = max(min(42 // bits, 16, n), 1)
    packed = np.zeros(n, np.int64)
    for i in range(h):
        packed <<= bits
        packed[: n - i] |= symbols[i:]
    packed = (packed << _BITS) | place
    packed.sort()
    order = packed & _MASK
    key = packed >> _BITS
    rank = np.empty(n + 1, np.int64)
    rank[n] = 0
    open_slots = _regroup(order, key, np.arange(n), rank)
    while len(open_slots):
        # Only groups of several suffixes are sorted again, by the rank h symbols further on.
        at = order[open_slots]
        further = rank[np.minimum(at + h, n)]
        key = ((((rank[at] - 1) << _BITS) + further) << _BITS) | at
        key.sort()
        order[open_slots] = key & _MASK
        open_slots = _regroup(order, key >> _BITS, open_slots, rank)
        h *= 2
    return order


def _regroup(order, key, slots, rank):
    """Give the suffixes in `slots` the rank of their group: its first slot + 1. Returns the slots
    of groups of several."""
    if not len(slots):
        return slots
    new = np.ones(len(slots), bool)
    new[1:] = key[1:] != key[:-1]
    begins = np.flatnonzero(new)
    sizes = np.diff(np.append(begins, len(slots)))
    group = np.repeat(np.arange(len(begins)), sizes)
    rank[order[slots]] = slots[begins][group] + 1
    return slots[sizes[group] > 1]


def common_prefixes(symbols, order, lane=256):
    """For each slot of a suffix array, how many symbols its suffix shares with the one before.

    Kasai's rule, that the value of position i + 1 is at least that of i less 1, is followed in
    many lanes side by side: stretches of `lane` positions, each begun anew.
    """
    n = len(order)
    slot = np.empty(n, np.int64)
    slot[order] = np.arange(n)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    ended = np.append(symbols.astype(np.int64), -1)
    begins = np.arange(0, n, lane)
    known = np.zeros(len(begins), np.int64)
    for step in range(min(lane, n)):
        at = begins + step
        if at[-1] >= n:
            at, known = at[:-1], known[:-1]
            begins = begins[:-1]
        if not len(at):
            break
        other = before[at]
        known = np.where(other < 0, 0, np.maximum(known - 1, 0)) if step else known
        live = np.flatnonzero(other >= 0)
        while len(live):
            a, b = at[live] + known[live], other[live] + known[live]
            # Past the end nothing is equal: the end differs from every symbol, and a from b.
            equal = (np.maximum(a, b) < n) & (ended[np.minimum(a, n)] == ended[np.minimum(b, n)])
            live = live[equal]
            known[live] += 1
        shared[at] = known
    return shared[order]
