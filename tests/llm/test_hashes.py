"""Hashes of words: patterns that cancel out in polynomials modulo a power of two are told apart."""

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from itemloom.llm.near_dedup import near_duplicates
from itemloom.llm.packing import pack_documents
from itemloom.llm.queries import vocabulary
from itemloom.llm.recompression import _PRIME, Sequences, _times
from itemloom.llm.substring_dedup import remove_repeats
from itemloom.llm.tokens import MAX_WORDS, WordTokenizer
from itemloom.llm.words import SpanHash, utf8, word_spans


def doubling(n, a="a", b="b"):
    """The pattern ab, abba, abbabaab, ... of n letters or words, and its mirror image."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return [a if x == 0 else b for x in bits], [b if x == 0 else a for x in bits]


@pytest.fixture(params=[512, 1024, 4096])
def mirrored(request):
    return ["".join(x) for x in doubling(request.param)]


def test_span_hashes(mirrored):
    words = [*mirrored, *("x" * n for n in range(1, 140)), "\0", "\0\0", "a\0", "\0a"]
    data, offsets = utf8(pa.array(words))
    for seed in range(20):
        found = SpanHash(seed).spans(data, offsets[:-1], offsets[1:])
        assert len(np.unique(found)) == len(words)
        again, at = utf8(pa.array(["..", *words]))
        assert (SpanHash(seed).spans(again, at[1:-1], at[2:]) == found).all()


def test_products_and_sequences():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, _PRIME, (2, 1000), dtype=np.uint64)
    a[:2], b[:2] = _PRIME - 1, [_PRIME - 1, 0]
    assert [int(x) for x in _times(a, b)] == [int(x) * int(y) % _PRIME for x, y in zip(a, b)]
    names = rng.integers(0, 1 << 64, 2, dtype=np.uint64)
    one, two = (np.array([names[0] if x == "a" else names[1] for x in own]) for own in doubling(8192))
    words = np.concatenate([one, two, one])
    sequences = Sequences(words, words)
    for which in (0, 1):
        x, y, z = sequences.spans(np.array([0, 8192, 16384]), np.array([8192, 16384, 24576]), which)
        assert x != y and x == z


def test_packing_and_files_of_mirrored_words(table, mirrored):
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    rows = pack_documents(table(list(enumerate(mirrored))), vocabulary("word_bpe_49k.json")).collect()
    import zlib

    for i, word in enumerate(mirrored):
        ids = [*library.encode(word, add_special_tokens=False).ids, 0][:2048]
        assert [r["ids_crc32"] for r in rows if r["doc_id"] == i and r["piece"] == 0] == [zlib.crc32(np.array(ids, dtype="<u4").tobytes())]
    own, library = WordTokenizer(vocabulary("byte_bpe_50k.json"), True), Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for word in mirrored:
        assert own.encode(*utf8(pa.array([word])))[0].tolist() == library.encode(word, add_special_tokens=False).ids


def test_words_that_share_a_hash_go_through_the_library():
    own, library = WordTokenizer(vocabulary("byte_bpe_50k.json"), True), Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    own.hash.spans = lambda data, start, end: np.full(len(start), 7, dtype=np.uint64)
    for text in ("one two three one", "three two", "one  four"):
        assert own.encode(*utf8(pa.array([text])))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_text_of_very_many_different_words(monkeypatch):
    monkeypatch.setattr("itemloom.llm.tokens.MAX_WORDS", 1 << 12)
    own, library = WordTokenizer(vocabulary("word_bpe_49k.json"), False), Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    assert MAX_WORDS > 1 << 12
    text = " ".join(f"w{i}" for i in range(40_000))
    assert own.encode(*utf8(pa.array([text, "w1 w2"])))[0].tolist() == library.encode(text + " w1 w2", add_special_tokens=False).ids


def test_repeats_and_near_copies_of_mirrored_words(table, mirrored):
    same = " ".join(f"w{k}" for k in range(12))
    rows = remove_repeats(table([(1, f"{same} {mirrored[0]}"), (2, f"{same} {mirrored[1]}"), (3, f"{same} {mirrored[1]}")])).collect()
    assert {r["doc_id"]: r["n_removed"] for r in rows} == {1: 0, 2: 0, 3: 13}
    rows = near_duplicates(table([(1, mirrored[0]), (2, mirrored[1])])).collect()
    assert all(r["kept"] for r in rows)


def test_repeats_of_mirrored_passages(table):
    one, two = doubling(4096, "left", "right")
    rows = remove_repeats(table([(1, " ".join(one)), (2, " ".join(two))]), width=4096).collect()
    assert all(r["n_removed"] == 0 for r in rows)


def test_words_are_spans_of_letters():
    data, offsets = utf8(pa.array(["a bc", "", " d"]))
    start, end, first = word_spans(data, offsets)
    assert (start.tolist(), end.tolist(), first.tolist()) == ([0, 2, 5], [1, 4, 6], [0, 2, 2, 3])
