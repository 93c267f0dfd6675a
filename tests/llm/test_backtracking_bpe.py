"""Byte-pair encoding by backtracking against the tokenizers library."""

import hashlib
import json

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from itemloom.llm.backtracking_bpe import BytePairs, byte_pairs, decode_documents, encode_documents
from itemloom.llm.queries import op11_bpe, vocabulary

BYTE = "byte_bpe_50k.json"
LIBRARY = Tokenizer.from_file(vocabulary(BYTE))
ODD = ["", " ", "\n", "a  b", "it's 's 'store don't ''", "x\t\ty 1234 z9z ...!!", "a<|endoftext|>b", "<|endoftext|>", "  <|endoftext|>  x", "<|endoftext|><|endoftext|> ",
       "é 日本語 😀 hi", "a\x1cb\x85c\xa0 d", "—dash— “q”", "tail  ", " \r\n x", "​ 　 z", "a" * 5000, "-=" * 900, " " * 300 + "x"]


def ids(text):
    return np.array(LIBRARY.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_every_character_is_split_as_by_the_library():
    tables, codes = byte_pairs(vocabulary(BYTE)), [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}1{chr(c)}{chr(c)}!" for c in codes[i : i + 64]) for i in range(0, len(codes), 64)]
    for text, found in zip(texts, LIBRARY.encode_batch(texts, add_special_tokens=False)):
        assert tables.encode(text) == np.array(found.ids, dtype="<u4").tobytes(), text


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=st.sampled_from("aehtin s'rlo\n-1"), max_size=120), st.text(alphabet="ab", max_size=200)))
def test_any_text(text):
    tables = byte_pairs(vocabulary(BYTE))
    raw = tables.encode(text)
    assert raw == ids(text)
    values = np.frombuffer(raw, dtype="<u4")
    assert tables.decode(values, np.array([0, len(values)])) == [text]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50_256), max_size=30))
def test_any_ids_are_decoded_as_by_the_library(values):
    tables = byte_pairs(vocabulary(BYTE))
    found = tables.decode(np.array(values, dtype=np.uint32), np.array([0, len(values)]))
    assert found == [LIBRARY.decode(values, skip_special_tokens=False)]


def test_pairs_and_pieces_against_plain_merges():
    """Merges one after the other, on the bytes: tokens, pairs and backtracking agree with them."""
    tables = BytePairs(vocabulary(BYTE))

    def merged(raw):
        parts = list(raw)
        while len(parts) > 1:
            found = [(tables.product[a << 32 | b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a << 32 | b in tables.product]
            if not found:
                break
            r, i = min(found)
            parts[i : i + 2] = [r]
        return parts

    rng = np.random.default_rng(3)
    for a, b in rng.integers(0, 50_256, (3000, 2)).tolist():
        if merged(tables.text[a]) == [a] and merged(tables.text[b]) == [b]:
            assert tables.compatible(a, b) == (merged(tables.text[a] + tables.text[b]) == [a, b])
    for n in range(300):
        raw = rng.choice(list(b"aehtinsrlo "), n).astype(np.uint8).tobytes()
        assert tables.piece(raw) == merged(raw)


def test_long_texts_in_stretches(table):
    rng = np.random.default_rng(4)
    spaced = "".join(rng.choice(list("ab  \n'1é"), 300_000))
    solid = "".join(rng.choice(list("abcdefgh"), 200_000))
    for text in (spaced, solid, "x" * 200_000, " " * 150_000 + "a b" * 50_000):
        assert byte_pairs(vocabulary(BYTE)).encode(text) == ids(text)


def test_documents(table):
    pairs = [(i, t) for i, t in enumerate(ODD)] + [(3, "again"), (3, "again"), (None, "no id"), (70, None)]
    rows = decode_documents(encode_documents(table(pairs), vocabulary(BYTE)), vocabulary(BYTE)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], bytes(r["ids"]), r["text"]) for r in rows), key=key) == sorted(((i, ids(t or ""), t or "") for i, t in pairs), key=key)
    assert encode_documents(table([]), vocabulary(BYTE)).collect() == []


def test_query(spark, sf_dir, documents):
    found = {r["doc_id"]: tuple(r)[1:] for r in op11_bpe(spark, sf_dir).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    expected = {}
    for r in documents.collect():
        text = r["text"] or ""
        back = LIBRARY.decode(LIBRARY.encode(text, add_special_tokens=False).ids, skip_special_tokens=False)
        expected[r["doc_id"]] = (len(ids(text)) // 4, sha(ids(text)), sha(back.encode()))
    assert found == expected


def test_other_kinds_of_files_are_refused(tmp_path):
    with open(vocabulary(BYTE)) as f:
        spec = json.load(f)
    spec["model"]["ignore_merges"] = True
    (tmp_path / "odd.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        BytePairs(str(tmp_path / "odd.json"))
