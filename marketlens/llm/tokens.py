"""Token ids of many texts with a public tokenizer: each distinct piece of text is encoded once.

Neither tokenizer joins anything across the start of a run of white space, in the sense of Unicode
(inside one, some do: blanks and no-break spaces in turn are one token). A piece begins at ASCII
white space that follows another character than white space, and goes up to the next one; the ids
of a text are those of its pieces.
The pieces are found, hashed and looked up as arrays. A piece that isn't known yet goes through
the normaliser, the pre-tokenizer and the model of the tokenizers library, one by one. A piece with
the string of an added token, which has no white space, is encoded by the library as a whole.
"""

import re

import numpy as np
from marketlens.llm import textbytes

#: Known pieces kept in a worker; beyond this they are forgotten, and encoded again when met.
KNOWN_PIECES = 3_000_000
#: New pieces that are normalised by one call.
TOGETHER = 32


#: White space of several bytes in UTF-8, as numbers of the last three bytes or, below 2**16, two.
_WIDE_SPACE = np.array(
    [
        int.from_bytes(chr(c).encode(), "big")
        for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
    ]
)


def _after_wide_space(data, at):
    """True where the character before a position is white space of several bytes."""
    last, middle, first = (data[np.maximum(at - i, 0)].astype(np.int64) for i in (1, 2, 3))
    two = middle << 8 | last
    return np.isin(two, _WIDE_SPACE) | np.isin(first << 16 | two, _WIDE_SPACE)


class Encoder:
    def __init__(self, path):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Without added tokens, a pattern that is found nowhere.
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._forget()

    def _forget(self):
        self.keys = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.sizes = np.empty(0, np.int64)
        self.parts = np.empty(1 << 16, self.dtype)
        self.used = 0
        self.words = {}

    def _normalised(self, texts):
        """Each text as the normaliser leaves it.

        Several go through it in one call, with a NUL between them: it is no white space, has no
        lower case, and nothing combines with it. Texts that hold one go through one by one.
        """
        if not self.tokenizer.normalizer:
            return texts
        normalise, out = self.tokenizer.normalizer.normalize_str, []
        for at in range(0, len(texts), TOGETHER):
            some = texts[at : at + TOGETHER]
            parts = normalise("\0".join(some)).split("\0")
            out += parts if len(parts) == len(some) else map(normalise, some)
        return out

    def _encode_new(self, texts):
        """Ids of each text, by way of the library's own stages."""
        tokenizer, words = self.tokenizer, self.words
        split, model = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model
        out = []
        for text, normalised in zip(texts, self._normalised(texts), strict=True):
            if self.added.search(text):
                out.append(tokenizer.encode(text, add_special_tokens=False).ids)
                continue
            ids = []
            for word, _ in split(normalised):
                known = words.get(word)
                if known is None:
                    known = words[word] = [t.id for t in model.tokenize(word)]
                ids += known
            out.append(ids)
        return out

    def _learn(self, keys, texts):
        encoded = self._encode_new(texts)
        if len(self.words) > KNOWN_PIECES // 4:
            self.words = {}
        sizes = np.array([len(x) for x in encoded], np.int64)
        ids = np.array([y for x in encoded for y in x], self.dtype)
        at = self.used + np.cumsum(sizes) - sizes
        if self.used + len(ids) > len(self.parts):
            grown = np.empty(2 * (self.used + len(ids)), self.dtype)
            grown[: self.used] = self.parts[: self.used]
            self.parts = grown
        self.parts[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.at = np.insert(self.at, place, at)
        self.sizes = np.insert(self.sizes, place, sizes)

    def encode(self, data, offsets):
        """(ids of all texts in a row, where each text's ids begin; one more for the end)."""
        space = textbytes.SPACE[data]
        first = np.zeros(len(data), bool)
        first[1:] = space[1:] & ~space[:-1]
        # Not many: only those after a byte of a longer character are looked at.
        wide = 1 + np.flatnonzero(first[1:] & (data[:-1] >= 0x80))
        first[wide[_after_wide_space(data, wide)]] = False
        first[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(data))
        if not len(starts):
            return np.empty(0, self.dtype), np.zeros(len(offsets), np.int64)
        keys = textbytes.RangeHash(data).of(starts, ends)
        distinct = np.unique(keys)
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
            new = distinct[self.keys[place] != distinct]
        else:
            new = distinct
        if len(self.keys) + len(new) > KNOWN_PIECES:
            self._forget()
            new = distinct
        if len(new):
            is_new = np.searchsorted(new, keys)
            is_new[is_new == len(new)] = 0
            which = np.flatnonzero(new[is_new] == keys)
            example = np.empty(len(new), np.int64)
            example[is_new[which]] = which
            raw = data.tobytes()
            texts = [
                raw[a:b].decode()
                for a, b in zip(starts[example].tolist(), ends[example].tolist(), strict=True)
            ]
            self._learn(new, texts)
        where = np.searchsorted(self.keys, keys)
        sizes = self.sizes[where]
        ids = textbytes.gather(self.parts, self.at[where], sizes)
        before = np.concatenate(([0], np.cumsum(sizes)))
        return ids, before[np.searchsorted(starts, offsets)]


_encoders = {}


def encoder(path):
    """The worker's encoder of a tokenizer file, with the pieces that it has met."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget_encoders():
    """Let go what a reused worker has met; tasks of operators that encode nothing begin with this."""
    _encoders.clear()


def with_end(ids, before, end_id):
    """The ids with one more at the end of each text."""
    n = len(before) - 1
    return np.insert(ids, before[1:], end_id), before + np.arange(n + 1)
