"""Byte-pair encoding by backtracking, and decoding by an offset table.

A sequence of tokens is what the merges make of a text if and only if each pair
of neighbours is what the merges make of the pair's own bytes. So a text is
encoded from left to right: take the longest token that starts here (found for
all places by one Aho-Corasick pass over the reversed bytes), go to the next
shorter one while it does not go with its left neighbour, and step back where
none does. The encoding of a prefix is unique, so a place from which there was
no way on never is a boundary again, and the whole takes linear time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .words import text_batches

#: Entries of the tables that fill while texts are encoded; a full one starts anew.
MAX_PIECES = MAX_PAIRS = 1 << 19

#: Longer pieces are encoded each time they occur.
KEPT_LETTERS = 64

#: Letters of one text split at a time, and as many more as there are up to the next space.
STRETCH = 1 << 16

#: Fixed values of the format: the split of a text before the merges, and the bytes that stand for themselves.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def _byte_letters() -> dict[str, int]:
    """The letter that the file writes for each byte; the others follow from U+0100 on."""
    others = [b for b in range(256) if b not in set(PLAIN_BYTES)]
    letters = {chr(b): b for b in PLAIN_BYTES} | {chr(0x100 + i): b for i, b in enumerate(others)}
    return dict(sorted(letters.items(), key=lambda x: x[1]))


class BytePairs:
    """The tables of one tokenizer file. Inside, a token's number is its rank:
    the bytes come first, then the merges in their order."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        split = spec["pre_tokenizer"] or {}
        odd = [model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback", "dropout")]
        added = spec["added_tokens"]
        if (
            model["type"] != "BPE" or any(odd) or spec["normalizer"] or split.get("type") != "ByteLevel"
            or split.get("add_prefix_space") or not split.get("use_regex", True)
            or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
        ):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        vocabulary = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        names = list(letters) + [a + b for a, b in merges]
        rank = {name: r for r, name in enumerate(names)}
        if len(rank) < len(names):
            raise ValueError(f"{path} makes one token by two merges")
        self.text = [bytes(letters[c] for c in name) for name in names]
        self.size = [len(t) for t in self.text]
        self.parts = [(r, r) for r in range(256)] + [(rank[a], rank[b]) for a, b in merges]
        self.product = {a << 32 | b: 256 + i for i, (a, b) in enumerate(self.parts[256:])}
        self.pairs: dict[int, bool] = {}
        # A token that its own merges never make cannot come out of any text.
        made = [True] * 256
        for r, (a, b) in enumerate(self.parts[256:], 256):
            made.append(made[a] and made[b] and self._stay_apart(a, b, r))
        known = {t: r for r, t in enumerate(self.text) if made[r]}
        self.shorter = [next((known[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in known), -1) for t in self.text]
        self.search = ahocorasick.Automaton()
        for t, r in known.items():
            self.search.add_word(t[::-1].decode("latin-1"), r)
        self.search.make_automaton()
        self.ids = [vocabulary[name].to_bytes(4, "little") for name in names]
        self.special = {t["content"]: t["id"].to_bytes(4, "little") for t in added}
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if added else None
        self.split, self.inner_space = regex.compile(PIECES), regex.compile(r"\S \S")
        self.pieces = _Pieces(self)
        self._offset_table(vocabulary, letters, added)

    def _offset_table(self, vocabulary: dict[str, int], letters: dict[str, int], added: list[dict]) -> None:
        texts = [b""] * (1 + max([*vocabulary.values(), *(t["id"] for t in added)]))
        for name, i in vocabulary.items():
            texts[i] = bytes(letters[c] for c in name)
        for t in added:
            texts[t["id"]] = t["content"].encode()
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        self.pool = np.frombuffer(b"".join(texts), dtype=np.uint8)

    def _stay_apart(self, a: int, b: int, until: int) -> bool:
        """Whether no merge ranked before ``until`` joins the last part of a with the first of b.

        The walk goes back in time: of the two parts that meet, the one made
        later is taken apart. A pair merges if its rank comes before either part
        is used up; at equal rank, the merge further left comes first.
        """
        used_a = used_b = until
        while True:
            made = self.product.get(a << 32 | b)
            if made is not None and made < used_a and made <= used_b:
                return False
            if a < 256 and b < 256:
                return True
            if a > b:
                used_a, a = a, self.parts[a][1]
            else:
                used_b, b = b, self.parts[b][0]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b as they are when b follows a."""
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._stay_apart(a, b, len(self.parts))
        return found

    def piece(self, raw: bytes) -> list[int]:
        """Ranks of the tokens of one piece."""
        n = len(raw)
        # The search gives the longest match of a place first, so it is the one that stays.
        found = dict(list(self.search.iter(raw[::-1].decode("latin-1")))[::-1])
        longest = [found[end] for end in range(n - 1, -1, -1)]
        no_way = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0] if n else -1
        while at < n:
            while token >= 0 and (no_way[at + self.size[token]] or (out and not self.compatible(out[-1], token))):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += self.size[token]
                token = longest[at] if at < n else -1
            else:
                no_way[at] = 1
                token = out.pop()
                at -= self.size[token]
                token = self.shorter[token]
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        out, at = [], 0
        for special in self.split_special.finditer(text) if self.split_special else ():
            out += [*self._plain(text, at, special.start()), self.special[special.group()]]
            at = special.end()
        return b"".join([*out, *self._plain(text, at, len(text))])

    def _plain(self, text: str, start: int, end: int) -> Iterator[bytes]:
        # What stands before a special token is split as if the text ended there.
        while start < end:
            cut = end
            if end - start > STRETCH:
                # A piece always starts at a space between two characters that are no white space.
                inner = self.inner_space.search(text, start + STRETCH, end)
                cut = inner.start() + 1 if inner else end
            yield b"".join(map(self.pieces.__getitem__, self.split.findall(text, start, cut)))
            start = cut

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """Texts of rows of ids, one row after the other; ``first`` has each row's first id (rows + 1).

        Bytes that are no UTF-8 become U+FFFD; an id without a token has no bytes.
        """
        at = np.minimum(ids.astype(np.int64), len(self.offsets) - 1)
        begin = self.offsets[at]
        sizes = self.offsets[np.minimum(at + 1, len(self.offsets) - 1)] - begin
        ends = np.concatenate([[0], np.cumsum(sizes)])
        raw = self.pool[np.repeat(begin - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        bounds = ends[first]
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:])]


class _Pieces(dict):
    """Ids of the pieces that a worker has met."""

    def __init__(self, tables: BytePairs):
        super().__init__()
        self.tables = tables

    def __missing__(self, piece: str) -> bytes:
        tables = self.tables
        ids = b"".join(map(tables.ids.__getitem__, tables.piece(piece.encode())))
        if len(piece) <= KEPT_LETTERS:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def byte_pairs(path: str) -> BytePairs:
    """One per worker process and file."""
    return BytePairs(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every row: the ids of its whole text as the library gives
    them without special tokens around, as little-endian unsigned 32-bit integers.

    A missing or empty text has no ids. Rows stay rows: those without a doc_id
    and repeated ones each have their own. A special token's string in a text is
    that token. Texts are worked on in batches of about 1 MB, a longer text in
    stretches, and other columns of any name are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = byte_pairs(path)
        for part, _, _ in text_batches(batches):
            ids = [tables.encode(t) if t else b"" for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text) of every row of (doc_id, ids); missing ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = byte_pairs(path)
        for batch in batches:
            first, column = 0, batch.column("ids").fill_null(b"")
            sizes = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]) // 4
            while first < len(sizes):
                # As many rows as have some 2^18 ids together, one at least.
                last = first + max(1, int(np.searchsorted(np.cumsum(sizes[first:]), 1 << 18, side="right")))
                rows = column.slice(first, last - first).to_pylist()
                ids = np.frombuffer(b"".join(rows), dtype="<u4")
                texts = tables.decode(ids, np.concatenate([[0], np.cumsum(sizes[first:last])]))
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), column.slice(first, last - first), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])
                first = last

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, text string")
