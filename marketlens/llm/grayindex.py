"""A hierarchical index of 64-bit fingerprints in Gray order, and the links that it finds.

Fingerprints sorted by their rank in the Gray code differ little from their neighbours. Every
WIDTH of them in a row get a node that holds, under a mask, the bits which all of them share, the
nodes get nodes in turn, and bits that a node shows are left out below it. A search descends from
the top: it adds up the bits in which a fingerprint differs from what nodes show, and leaves out
all that is below a node once the sum is too large.
"""

import numpy as np

WIDTH = 8
#: Fingerprints that search together, and pairs of a fingerprint and a node held at a time.
QUERIES, PAIRS = 4096, 1 << 20
ALL = np.uint64(2**64 - 1)


def gray_rank(codes):
    """The places of unsigned 64-bit codes in the reflected Gray code."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def build(codes):
    """Levels (own mask, bits) of the index over codes in Gray order, the codes themselves first."""
    masks, both, either = [np.full(len(codes), ALL)], codes, codes
    bits = [codes]
    while len(both) > 1:
        firsts = np.arange(0, len(both), WIDTH)
        both, either = np.bitwise_and.reduceat(both, firsts), np.bitwise_or.reduceat(either, firsts)
        masks.append(~(both ^ either))
        bits.append(both)
    own = [m & ~np.repeat(up, WIDTH)[: len(m)] for m, up in zip(masks, masks[1:])] + masks[-1:]
    return list(zip(own, bits))


def _one_label(labels, levels):
    """Per level the label that all codes below a node have, or -1."""
    low = high = labels
    found = [labels]
    for _ in levels[1:]:
        firsts = np.arange(0, len(low), WIDTH)
        low, high = np.minimum.reduceat(low, firsts), np.maximum.reduceat(high, firsts)
        found.append(np.where(low == high, low, -1))
    return found


def _merge(labels, a, b):
    """`labels` after those of a and b have become one, the smaller of them."""
    parent = np.arange(len(labels))
    a, b = labels[a], labels[b]
    while True:
        apart = a != b
        if not apart.any():
            return parent[labels]
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        a, b = parent[a], parent[b]


def components(codes, most, fixed=0):
    """Per code, in Gray order, the place of the first one that it reaches.

    Codes that agree in the bits of `fixed` are linked if they differ in at most `most` bits. What
    is known to be connected isn't compared any more, so that dense groups cost little.
    """
    fixed = np.uint64(fixed)
    levels = build(codes)
    labels = np.arange(len(codes))
    for first in range(0, len(codes), QUERIES):
        known = _one_label(labels, levels)
        queries = np.arange(first, min(first + QUERIES, len(codes)))
        top = len(levels) - 1
        waiting = [(top, queries, np.zeros_like(queries), np.zeros(len(queries), np.int64))]
        while waiting:
            level, query, node, apart = waiting.pop()
            own, bits = levels[level]
            different = (codes[query] ^ bits[node]) & own[node]
            apart = apart + np.bitwise_count(different)
            # Only codes further on are of interest, and only those not known to be connected.
            near = (apart <= most) & (different & fixed == 0) & ((node + 1) * WIDTH**level > query + 1)
            near &= known[level][node] != known[0][query]
            query, node, apart = query[near], node[near], apart[near]
            if level == 0:
                if len(query):
                    labels = _merge(labels, query, node)
                continue
            below = len(levels[level - 1][1])
            for i in range(0, len(query), PAIRS // WIDTH):
                part = slice(i, i + PAIRS // WIDTH)
                child = (node[part, None] * WIDTH + np.arange(WIDTH)).ravel()
                real = child < below
                waiting.append((
                    level - 1, np.repeat(query[part], WIDTH)[real], child[real], np.repeat(apart[part], WIDTH)[real]
                ))
    return labels
