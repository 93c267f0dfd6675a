"""Tokens, packing and token files against the tokenizers library."""

import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from itemloom.llm.packing import best_place, pack_documents
from itemloom.llm.queries import vocabulary
from itemloom.llm.simple8b import LAYOUT, decode, encode
from itemloom.llm.token_files import read_tokens, token_files, write_tokens
from itemloom.llm.tokens import WordTokenizer
from itemloom.llm.words import utf8

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
ODD = ["", " ", "\n", "a  b", "it's 's 'store don't ''", "x\t\ty 1234 z9z ...!! ','s", "a<|endoftext|>b", "éa   b \n\n c ", "—dash— “q” 日本語",
       "É ß Σ İ", "a\x1cb", "😀 hi", "é x", " nbsp", "' ' '", "tail  ", " \r\n x", "<|startoftext|>"]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize(("file", "spaced"), [(WORD, False), (BYTE, True)])
def test_ids_equal_the_library(documents, file, spaced):
    texts = ODD + [r["text"] for r in documents.collect()]
    own, library = WordTokenizer(vocabulary(file), spaced), Tokenizer.from_file(vocabulary(file))
    for _ in range(2):  # the second time from the table
        ids, first = own.encode(*utf8(pa.array(texts)))
        for i, t in enumerate(texts):
            assert ids[first[i] : first[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab Z'\n\t1é,.s<|>—́ 日"), max_size=20), min_size=1, max_size=5))
def test_any_text_equals_the_library(texts):
    for file, spaced in ((WORD, False), (BYTE, True)):
        own, library = _cached(file, spaced)
        ids, first = own.encode(*utf8(pa.array(texts)))
        for i, t in enumerate(texts):
            assert ids[first[i] : first[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


_CACHE = {}


def _cached(file, spaced):
    if file not in _CACHE:
        _CACHE[file] = WordTokenizer(vocabulary(file), spaced), Tokenizer.from_file(vocabulary(file))
    return _CACHE[file]


def test_packing_is_whole_gapless_and_tight(table):
    texts = [(i, " ".join(["word"] * n)) for i, n in enumerate([0, 1, 5, 100, 2046, 2047, 2048, 5000, 700, 1300] * 6)] + [(900, None), (901, "")]
    rows = pack_documents(table([*texts, (None, "x")]), vocabulary(WORD)).collect()
    library = Tokenizer.from_file(vocabulary(WORD))
    expected = {}
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        expected |= {(i, k // 2048): (k, len(ids[k : k + 2048]), crc(ids[k : k + 2048])) for k in range(0, len(ids), 2048)}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == expected
    filled = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert filled.setdefault(r["sequence_id"], 0) == r["offset"]
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 2048
    assert len(filled) <= -(-sum(r["length"] for r in rows) // 2048) + 2
    assert pack_documents(table([]), vocabulary(WORD)).collect() == []


def test_packing_loses_little():
    lengths = np.minimum(2048, np.random.default_rng(1).lognormal(6, 1, 20_000).astype(int) + 1)
    bins, offset = best_place(lengths, 2048)
    assert bins.max() + 1 <= 1.002 * -(-lengths.sum() // 2048)
    for b in range(200):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offset[own])]
        assert (np.cumsum(lengths[own]) - lengths[own] == offset[own]).all() and lengths[own].sum() <= 2048


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, (1 << 64) - 1)), max_size=1500))
def test_simple8b_round_trip(values):
    values = np.array(values, dtype=np.uint64)
    assert (decode(*encode(values), len(values)) == values).all()
    assert (decode(*encode(values, 64), len(values), 64) == values).all()


def test_simple8b_words_hold_the_most_values_that_fit():
    """Word by word as in a plain loop, over all widths and at the ends of blocks."""
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.integers(0, 1 << bits, 90, dtype=np.uint64) for bits in (1, 2, 9, 16, 33, 60)] + [np.zeros(700, dtype=np.uint64)])
    words, first, _ = encode(values)
    plain, starts = [], []
    for a in range(0, len(values), 512):
        rest = values[a : a + 512].tolist()
        starts.append(len(plain))
        while rest:
            selector = next(k for k, (n, bits) in enumerate(LAYOUT) if max(rest[:n]) < 1 << bits)
            n, bits = LAYOUT[selector]
            plain.append(sum(v << k * bits for k, v in enumerate(rest[:n] if bits else [])) | selector << 60)
            rest = rest[n:]
    assert words.tolist() == plain and first.tolist() == starts


def test_simple8b_takes_few_steps():
    """Words are found side by side and filled together: no step per word and selector."""
    found = []
    sys.setprofile(lambda frame, event, arg: found.append(1) if event == "c_call" else None)
    try:
        encode(np.random.default_rng(1).integers(0, 1 << 16, 1 << 16, dtype=np.uint64) >> np.uint64(3))
    finally:
        sys.setprofile(None)
    assert len(found) < 2500


def test_token_files(spark, table, tmp_path):
    pairs = [(5, "Hello world, it's 2024"), (-3, None), (9, ""), (7, "x y z " * 30_000), (None, "gone"), (6, "naïve — text")]
    library = Tokenizer.from_file(vocabulary(BYTE))
    expected, start = {}, 0
    for i, t in sorted((p for p in pairs if p[0] is not None), key=lambda p: p[0]):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        expected[i] = (start, len(ids), crc(ids), ids)
        start += len(ids)
    write_tokens(table(pairs), vocabulary(BYTE), str(tmp_path / "tokens"))
    rows = read_tokens(spark, str(tmp_path / "tokens"), with_ids=True).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in rows} == expected
    assert token_files(table([]), vocabulary(BYTE)).collect() == []
