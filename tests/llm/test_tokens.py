import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from marketlens.llm import packing, textbytes, tokenfiles, tokens
from marketlens.llm.runtime import stored
from marketlens.llm.textbytes import flat
from marketlens.llm.tokens import Encoder
from marketlens.session import new_table_path
from pyarrow import fs

from tests.llm.tools import corpus, frame

TEXTS = [
    "", " ", "a", "  two  blanks ", "Don't we'll", "\n\n new\tline\r\n", "ÀÉ éé́ ß", "a  b c 　",
    "12 345,67!!", "<|endoftext|> x", "日本語 テキスト", "x" * 5000, "́ mark", "trailing   ", "ΑΣ ΟΔΟΣ", "İI",
    "a\x1cb \x85c", "emoji 👩‍👩‍👧 x", "'s 's", " 's",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    alphabet = "abcXYZ  \n\t.,'é  ßÑ0189́-<|>s"
    return TEXTS + [t or "" for _, t in corpus()] + [
        "".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_whole_texts(name, texts, monkeypatch):
    from marketlens.llm import tokens

    coder = Encoder(public_tokenizers.path(name))
    coder.tokenizer.encode_special_tokens = True
    whole = [e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for most in (3_000_000, 1000):
        monkeypatch.setattr(tokens, "KNOWN_PIECES", most)
        for part in (texts, texts[::-1], texts):
            ids, before = coder.encode(*flat(pa.array(part)))
            found = [ids[a:b].tolist() for a, b in zip(before, before[1:], strict=False)]
            assert found == (whole if part is texts else whole[::-1])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_mixed_white_space(name):
    rng = random.Random(17)
    spaces = "  \u00a0\u00a0\n\t\x85\u1680\u180e\u2000\u2003\u200a\u200b\u2028\u2029\u202f\u205f\u3000"
    texts = ["a \u00a0 \u00a0 b", "\u00a0 \u00a0 x", "x\u00a0", " y", "\u00a0", " \u00a0 z \u00a0"] + [
        "".join(rng.choice(spaces) if rng.random() < 0.7 else rng.choice("abé日.") for _ in range(30))
        for _ in range(500)]
    texts += ["".join(rng.choice("  \u00a0\u00a0a") for _ in range(40)) for _ in range(300)]
    coder = Encoder(public_tokenizers.path(name))
    whole = [e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    ids, before = coder.encode(*flat(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(before, before[1:], strict=False)] == whole


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_added_tokens(name):
    rng = random.Random(23)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", " ", "  ", "\n", "\u00a0", "ab", "É", "\u0301", "'s"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(600)]
    coder = Encoder(public_tokenizers.path(name))
    whole = [e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    ids, before = coder.encode(*flat(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(before, before[1:], strict=False)] == whole


def test_token_files(spark):
    rows = corpus(40) + [(None, "without id")]
    path = public_tokenizers.path("word_bpe_49k.json")
    coder = Encoder(path).tokenizer
    folder = new_table_path(spark, "tokens-test")
    index = tokenfiles.write_token_files(frame(spark, rows, parts=5), folder, path, 1, length=16)
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.read_documents(index, folder).collect()}
    start, expected = 0, {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = coder.encode(text or "", add_special_tokens=False).ids + [1]
        expected[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert found == expected


def test_token_files_of_odd_tables(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    df = frame(spark, [(1, "a", "x"), (1, "a", "x"), (2, None, "x")], "doc_id long, text string, file string")
    found = tokenfiles.token_file_round_trip(df, path).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in found) == [(1, 0, 2), (1, 2, 2), (2, 4, 1)]
    assert tokenfiles.token_file_round_trip(df.limit(0), path).collect() == []


def test_random_access_without_copies(tmp_path):
    name = str(tmp_path / "x.arrow")
    with pa.OSFile(name, "wb") as sink:
        writer = tokenfiles.TokenWriter(sink, np.uint16, length=8)
        ids = np.arange(5000, dtype=np.uint16)
        for part in np.array_split(ids, 7):
            writer.append(part)
        writer.close()
    reader = tokenfiles.open_tokens(fs.LocalFileSystem(), name)
    for first, n in ((0, 1), (1020, 10), (1024, 1024), (17, 4983), (4999, 1), (5, 0)):
        assert reader.tokens(first, n).tolist() == list(range(first, first + n))
    matrix, mask = reader.sequences(4)
    assert matrix.shape[1] == 8 and mask.sum() == 5000 - 4 * 8 * tokenfiles.SEQUENCES
    assert not reader.tokens(3, 4).flags.owndata


def best_possible(lengths, capacity):
    """The least number of sequences, by trying all."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in {room: j for j, room in enumerate(rooms)}.values():
            if rooms[k] >= lengths[i]:
                rooms[k] -= lengths[i]
                go(i + 1, rooms)
                rooms[k] += lengths[i]
        rooms.append(capacity - lengths[i])
        go(i + 1, rooms)
        rooms.pop()

    go(0, [])
    return best[0]


def test_reduction_keeps_the_best_packing():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.randrange(6, 25)
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))]
        counts = {x: lengths.count(x) for x in lengths}
        fixed, left = packing.reduced(counts, capacity)
        rest = [x for x, n in left.items() for _ in range(n)]
        assert sum(fixed.values()) + best_possible(rest, capacity) == best_possible(lengths, capacity)
        used = [x for lengths, n in fixed.items() for x in lengths * n]
        assert sorted(used + rest) == sorted(lengths)
        assert all(sum(x) <= capacity for x in fixed)


def test_best_fit_equals_one_by_one():
    rng = random.Random(2)
    for _ in range(100):
        capacity = rng.randrange(5, 60)
        counts = {rng.randrange(1, capacity + 1): rng.randrange(1, 30) for _ in range(8)}
        rooms = []
        for x in sorted(counts, reverse=True):
            for _ in range(counts[x]):
                fits = [r for r in rooms if r >= x]
                if fits:
                    rooms.remove(min(fits))
                rooms.append((min(fits) if fits else capacity) - x)
        packed = packing.best_fit(counts, capacity)
        assert sum(packed.values()) == len(rooms)
        assert sorted(capacity - sum(x) for x, n in packed.items() for _ in range(n)) == sorted(rooms)


def test_packs_pieces_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 5)
    rows = corpus(50) + [(None, "x"), (0, "again")]
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = Encoder(path).tokenizer
    table = stored(packing.pieces(frame(spark, rows), path, 0, 64), "pieces-test")
    found = packing.placed(table, 64).collect()
    texts = dict(rows[:-1])
    by_sequence, starts = {}, {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        starts.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    for doc_id in set(texts) - {0}:
        ids = np.array(coder.encode(texts[doc_id] or "", add_special_tokens=False).ids + [0], "<u4")
        parts = sorted(starts[doc_id])
        assert [p[0] for p in parts] == list(range(-(-len(ids) // 64)))
        at = 0
        for number, start, length, crc in parts:
            assert start == at and crc == zlib.crc32(ids[at : at + length].tobytes())
            assert length == 64 or number == 0
            at += length
        assert at == len(ids)
    assert sum(r.length for r in found) > 64 * (len(by_sequence) - 2)
    assert packing.pack(frame(spark, []), path).collect() == []


def test_a_forgotten_encoder_gives_the_same_ids_again():
    path = public_tokenizers.path("byte_bpe_50k.json")
    data, offsets = textbytes.flat(pa.array(["some words, some more", None, "", "more  words"]))
    first = tokens.encoder(path)
    ids, before = first.encode(data, offsets)
    tokens.forget_encoders()
    textbytes.give_back()
    second = tokens.encoder(path)
    again, ends = second.encode(data, offsets)
    assert second is not first
    assert ids.tolist() == again.tolist() and before.tolist() == ends.tolist()


def test_new_pieces_are_normalised_together():
    """Few calls of the normaliser, and the same ids as the library's, also with NULs and marks."""
    texts = [f"Word{i} \u0301mark{i}\tE\u0301{i} \0 \x1cx\0\u0301y{i}" for i in range(200)] + ["\u0301a", "\0", "\0\0 b"]
    coder = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    library, calls = coder.tokenizer, []

    class Counted:
        def __getattr__(self, name):
            return getattr(library, name)

        @property
        def normalizer(self):
            class Stage:
                def normalize_str(self, text):
                    calls.append(text)
                    return library.normalizer.normalize_str(text)

            return Stage()

    coder.tokenizer = Counted()
    plain = [f"plain{i} words{i}" for i in range(400)]
    coder.encode(*textbytes.flat(pa.array(plain)))
    assert len(calls) <= 800 / tokens.TOGETHER + 1
    ids, before = coder.encode(*textbytes.flat(pa.array(texts)))
    for i, text in enumerate(texts):
        assert ids[before[i] : before[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids
