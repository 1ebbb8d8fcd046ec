"""Token counts, the piece codec and word ids against the libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tallystone.llm.common import Memo, map_texts
from tallystone.llm.normalise import CharacterMap, Normaliser
from tallystone.llm.piece_codec import decode_ids, encode_texts, piece_codec
from tallystone.llm.token_counts import count_tokens, token_counter
from tallystone.llm.word_ids import word_ids
from tests.llm.helpers import TEXTS, edge_documents, empty_documents

MODEL = P.path("piece_bpe_32k.model")
WORDS = P.path("word_bpe_49k.json")
ALPHABET = [*"abcdeth  ▁.,!?'\"0123_-\n\té€中日🙂ß<>²½K", "the", "ing", "</s>", "<s>", "<0x41>", "  ", "\x00", "'s", "'LL", "<|endoftext|>", "İ", "Σ", "é"]
texts = st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=600, deadline=None)
@given(texts)
def test_counts_and_ids_equal_the_library(text):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = library.encode(text)
    codec = piece_codec(MODEL)
    mine, ends = codec.encode(text)
    assert token_counter(MODEL)(text) == len(ids)
    assert mine.tolist() == ids
    assert codec.decode(ids) == library.decode(ids)
    assert not len(ends) or ends[-1] == len(text.encode())
    assert (np.diff(np.r_[0, ends]) >= 0).all()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 260), st.integers(259, 31_999), st.sampled_from([29_871, 259])), max_size=12))
def test_any_ids_decode_as_the_library_does(ids):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert piece_codec(MODEL).decode(ids) == library.decode(ids)


@settings(max_examples=400, deadline=None)
@given(texts)
def test_word_ids_equal_the_library(text):
    encode = word_ids(WORDS)
    assert np.frombuffer(encode(text), "<u4").tolist() == encode.library.encode(text, add_special_tokens=False).ids


def test_word_ids_of_every_letter_equal_the_library():
    """Each code point of the two-byte range and beyond, alone, between small letters, between capitals, and after a digit."""
    encode = word_ids(WORDS)
    for c in [*range(0x20, 0x800), *range(0x1E00, 0x2100), *range(0x2C60, 0x2C80), *range(0xA720, 0xA800), 0x212A, 0x212B, 0xFB01, 0x1F642]:
        x = chr(c)
        for text in (x, f"ab{x}cd", f"AZ{x}RB", f"7{x} {x}", f"{x}'S {x}{x}"):
            assert np.frombuffer(encode(text), "<u4").tolist() == encode.library.encode(text, add_special_tokens=False).ids, (hex(c), text)


@pytest.mark.parametrize("text", ["AZƏRBAYCAN", "Ɓauna da Ɗan", "Ɖevi Ƒe Ŋutsu", "İSTANBUL", "ȺȾɃɄɅ ƁƆ", "ǅ ǈ ǋ ǲ ẞ ß ſ"])
def test_word_ids_of_capitals_that_lower_far_away(text):
    encode = word_ids(WORDS)
    assert np.frombuffer(encode(text), "<u4").tolist() == encode.library.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(min_codepoint=0x20, max_codepoint=0x260), max_size=30))
def test_word_ids_of_two_byte_texts_equal_the_library(text):
    encode = word_ids(WORDS)
    assert np.frombuffer(encode(text), "<u4").tolist() == encode.library.encode(text, add_special_tokens=False).ids


def test_spans_cover_the_source_bytes():
    codec = piece_codec(MODEL)
    text = "Hé the ▁x 中🙂 end."
    ids, ends = codec.encode(text)
    raw, begin = text.encode(), 0
    pieces = []
    for end in ends:
        pieces.append(raw[begin:end])
        begin = end
    assert b"".join(pieces) == raw and len(pieces) == len(ids)
    plain = [codec.model.pieces[i] for i in codec.encode("and then the end")[0]]
    assert "".join(plain).replace("▁", " ").strip() == "and then the end"


@settings(max_examples=200, deadline=None)
@given(texts)
def test_spans_by_a_scalar_normaliser(text):
    codec = piece_codec(MODEL)
    normal, source = codec.normalise(text.encode())
    plain, places = [], []
    if text:
        plain, places = [b for b in "▁".encode()], [0, 0, 0]
    for at, b in enumerate(text.encode()):
        new = "▁".encode() if b == 0x20 else bytes([b])
        plain += [*new]
        places += [at] * len(new)
    assert normal == bytes(plain) and source.tolist() == [*places, len(text.encode())]


def test_merges_are_counted_as_brute_force_makes_them():
    model = piece_codec(MODEL).model
    rng = random.Random(7)
    for _ in range(300):
        chunk = "▁" + "".join(rng.choice("abcdethingor") for _ in range(rng.randrange(1, 14)))
        symbols, merges = [*chunk], 0
        while True:
            ranked = [(model.rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in model.rank]
            if not ranked:
                break
            i = min(ranked)[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            merges += 1
        assert model.merge(chunk)[2] == merges == len(chunk) - len(symbols)
        assert token_counter(MODEL).count_chunk(chunk) == len(symbols)


def _map_of(rules: dict[bytes, bytes]) -> bytes:
    """A compiled map: a double array with one key byte a level, built naively."""
    import struct

    blob, offsets = b"", {}
    for new in dict.fromkeys(rules.values()):
        offsets[new] = len(blob)
        blob += new + b"\0"
    units = [0] * (1 << 14)
    free = [256]

    def place(prefix: bytes, at: int) -> None:
        """Children of the node at `at` go to a block of their own."""
        base = free[0]
        free[0] += 256
        children = sorted({k[len(prefix)] for k in rules if k.startswith(prefix) and len(k) > len(prefix)})
        own = prefix in rules
        units[at] |= ((at ^ base) << 10) | (0x100 if own else 0)
        if own:
            units[base] = 0x80000000 | offsets[rules[prefix]]
        for c in children:
            units[base ^ c] = c
            place(prefix + bytes([c]), base ^ c)

    place(b"", 0)
    return struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + blob


class _Spec:
    def __init__(self, rules=None, prefix=True, squeeze=True):
        self.precompiled_charsmap = _map_of(rules) if rules else b""
        self.add_dummy_prefix, self.remove_extra_whitespaces = prefix, squeeze


def test_longest_prefix_wins_and_offsets_point_to_its_source():
    rules = {b"a": b"1", b"ab": b"2", b"abc": b"xyz", "é".encode(): b"e"}
    m = CharacterMap(_map_of(rules))
    assert m.longest(b"abcd", 0) == (3, b"xyz")
    assert m.longest(b"abd", 0) == (2, b"2")
    assert m.longest(b"ad", 0) == (1, b"1")
    assert m.longest(b"zab", 0) is None
    out, source = Normaliser(_Spec(rules, prefix=False, squeeze=False))("abcéa".encode())
    assert out == b"xyze1"
    assert source.tolist() == [0, 0, 0, 3, 5, 6]


def test_extra_white_space_is_squeezed_with_offsets():
    out, source = Normaliser(_Spec())(b"  a  b ")
    assert out.decode() == "▁a▁b"
    assert source.tolist() == [2, 2, 2, 2, 3, 3, 3, 5, 6]


def test_operators_over_edge_rows(spark, library):
    rows = count_tokens(edge_documents(spark), MODEL).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == sorted(
        (i or 0, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in TEXTS
    )
    outputs = ("ids", "begins", "ends", "n_tokens", "ids_sha256", "decoded", "decoded_sha256", "spanned_bytes")
    coded = encode_texts(edge_documents(spark), MODEL, outputs, add_eos=True)
    by_text = {(i, t or ""): library.encode(t or "", add_eos=True) for i, t in TEXTS}
    for r in coded.collect():
        want = next(v for (i, t), v in by_text.items() if i == r.doc_id and v == r.ids)
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded == library.decode(want)
        assert r.spanned_bytes == (r.ends[-1] if r.ends else 0)
    assert {r.text for r in decode_ids(coded, MODEL).collect()} == {library.decode(v) for v in by_text.values()}
    assert count_tokens(empty_documents(spark), MODEL).count() == 0
    assert encode_texts(empty_documents(spark), MODEL).count() == 0


def test_a_long_chunk_without_spaces():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = "".join(random.Random(5).choice("abcde") for _ in range(30_000))
    assert token_counter(MODEL)(text) == len(library.encode(text))


def test_a_process_keeps_one_memo():
    one, other = Memo(str.upper, 2), Memo(len)
    assert [one[w] for w in "abca"] == [*"ABCA"] and len(one) + len(one.old) > 2
    assert other["abc"] == 3 and not one and not one.old
    assert one["a"] == "A" and not other


def test_a_worker_hands_back_what_a_task_has_freed(spark):
    """100 MB of small pieces of memory with one on top that stays; a later task asks by how much its worker has grown."""

    def task(fill: bool):
        def make():
            import builtins
            import re

            with open("/proc/self/smaps_rollup") as f:
                mb = int(re.search(r"Pss_Anon: +(\d+)", f.read())[1]) >> 10
            held = [bytearray(2000) for _ in range(50_000)] if fill else []
            if fill:
                builtins._before, builtins._stays = mb, bytearray(2000)
            grown = mb - getattr(builtins, "_before", 1 << 20)
            return lambda texts: [pa.array([len(held) or grown] * len(texts), pa.int64())]

        return task_rows(make)

    def task_rows(make):
        return [r["n"] for r in map_texts(docs, make, "n long").collect()]

    docs = spark.range(64).repartition(8).selectExpr("id doc_id", "'a' text")
    assert task(True) == [50_000] * 64
    known = [n for n in task(False) if n > -(1 << 19)]
    assert known and max(known) < 50
