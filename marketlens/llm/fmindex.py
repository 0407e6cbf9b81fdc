"""An FM-index over sequences of integers, for many searches side by side.

The Burrows-Wheeler transform lies in a wavelet matrix: one bit vector per bit of a symbol, with
counts per 64-bit word. A backward search step takes as many rank lookups as a symbol has bits,
and is done for all searches at once.
"""

import numpy as np
from marketlens.llm.suffixes import suffix_array

_ONE = np.uint64(1)


class WaveletMatrix:
    def __init__(self, symbols, n_symbols):
        self.bits = max(int(n_symbols - 1).bit_length(), 1)
        self.words, self.counts, self.zeros = [], [], []
        rest = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (rest >> level) & 1
            padded = np.zeros(-(-(len(rest) + 1) // 64) * 64, np.uint8)
            padded[: len(rest)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(words)
            ones = np.bitwise_count(words).astype(np.int64)
            self.counts.append(np.cumsum(ones) - ones)
            self.zeros.append(len(rest) - int(ones.sum()))
            rest = np.concatenate((rest[bit == 0], rest[bit == 1]))
        self.begin = self._down(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _down(self, symbols, at):
        for level in range(self.bits):
            word = at >> 6
            below = (_ONE << (at & 63).astype(np.uint64)) - _ONE
            ones = self.counts[level][word] + np.bitwise_count(self.words[level][word] & below)
            up = (symbols >> (self.bits - 1 - level)) & 1
            at = np.where(up, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbols, at):
        """How often symbols[i] occurs before place at[i]."""
        return self._down(symbols, at) - self.begin[symbols]


class FMIndex:
    def __init__(self, symbols, n_symbols):
        """symbols: integers from 1 to n_symbols - 1."""
        self.text = symbols
        order = suffix_array(symbols)
        # The end of the text sorts first; its own symbol is 0 and occurs once.
        last = np.concatenate(([len(symbols) - 1], order - 1))
        transform = np.where(last >= 0, symbols[last], 0).astype(np.int64)
        self.matrix = WaveletMatrix(transform, n_symbols)
        counts = np.bincount(transform, minlength=n_symbols)
        self.before = np.cumsum(counts) - counts
        self.size = len(transform)

    def extended(self, symbols, low, high):
        """The suffix ranges of symbols[i] followed by what low[i] to high[i] stand for."""
        ends = self.matrix.rank(np.concatenate((symbols, symbols)), np.concatenate((low, high)))
        first = self.before[symbols]
        return first + ends[: len(symbols)], first + ends[len(symbols) :]

    def repeated_windows(self, starts, sizes, window):
        """Which windows of some stretches of the text occur more than once in it.

        Returns (stretch, start, size) of maximal runs found, places from the stretch's start: a
        string of at least `window` symbols that occurs again. All stretches are searched side by
        side, each from its end backwards, as matching statistics: the longest repeated string
        that ends at a place. After a hit the search goes on with the next window that reaches
        further left. A short probe in the middle comes first: where it is unique, so are all
        windows around it.
        """
        out = [[], [], []]
        lane = np.flatnonzero(sizes >= window)
        end = sizes[lane] - 1
        probing = np.ones(len(lane), bool)
        depth = window // 2
        while len(lane):
            # Ends of this round's searches: `depth` places before the last window's end.
            back = np.where(probing, np.minimum(depth, end - (window - 1)), 0)
            from_end = end - back
            length = self._longest(starts[lane], from_end, np.where(probing, window - back, sizes[lane]))
            whole_probe = probing & (length >= window - back)
            failed_probe = probing & ~whole_probe
            hit = ~probing & (length >= window)
            out[0].append(lane[hit])
            out[1].append((from_end - length + 1)[hit])
            out[2].append(length[hit])
            # A unique probe rules out all windows that hold it, a unique window only itself.
            end = np.where(failed_probe, from_end - 1, end)
            end = np.where(hit, from_end - length + window - 1, end)
            end = np.where(~probing & ~hit, end - 1, end)
            probing = ~whole_probe
            going = end >= window - 1
            lane, end, probing = lane[going], end[going], probing[going]
        return [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]

    def _longest(self, starts, ends, most):
        """Lengths, `most` at most, of the longest strings that end at starts + ends, begin at
        `starts` or later, and occur more than once."""
        length = np.zeros(len(starts), np.int64)
        live = np.arange(len(starts))
        low = np.zeros(len(starts), np.int64)
        high = np.full(len(starts), self.size)
        most = np.minimum(most, ends + 1)
        while len(live):
            at = starts[live] + ends[live] - length[live]
            low, high = self.extended(self.text[at], low, high)
            more = high - low > 1
            live, low, high = live[more], low[more], high[more]
            length[live] += 1
            more = length[live] < most[live]
            live, low, high = live[more], low[more], high[more]
        return length
