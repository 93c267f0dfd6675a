"""Token ids of text columns: the tokenizers library, called once for each distinct word.

Both vocabularies split a text into words before they look at merges. The split
is done on bytes here, each distinct word goes through the library once per
worker, and a text is put together from its words. Texts with characters for
which that is not certain (special token strings, characters that normalise or
combine, white space beyond ASCII) go through the library whole.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np

from .words import LANE_BYTES, LOWER, SpanHash, lane, lanes

LETTER, NUMBER, OTHER, SPACE, WHOLE = range(5)

#: Distinct words kept per worker; beyond, the table starts anew.
MAX_WORDS = 1 << 20


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each character of the basic plane; WHOLE: the text needs the library as a whole."""
    out = np.full(1 << 16, WHOLE, dtype=np.uint8)
    for code in range(1 << 16):
        char = chr(code)
        kind = unicodedata.category(char)
        if char in " \t\n\r\v\f":
            out[code] = SPACE
        elif kind[0] in "CMZ" or 0x1100 <= code < 0x1200 or not unicodedata.is_normalized("NFC", char) or char in "İΣ":
            continue
        else:
            out[code] = LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else OTHER
    return out


def _with_room(values: np.ndarray, size: int) -> np.ndarray:
    """The same values in an array of at least ``size``; it doubles when it has to grow."""
    if len(values) >= size:
        return values
    out = np.zeros(max(size, 2 * len(values)), dtype=values.dtype)
    out[: len(values)] = values
    return out


class WordTokenizer:
    """``spaced``: a word takes one space before it along, and other white space is tokens, too."""

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.spaced = spaced
        self.hash = SpanHash(87)
        self._reset()

    def _reset(self) -> None:
        self.mask = 4 * MAX_WORDS - 1
        self.keys = np.zeros(self.mask + 1, dtype=np.uint64)
        self.index = np.zeros(self.mask + 1, dtype=np.int32)
        # Ids and bytes of the known words, one after the other; what is filled ends at the last start.
        self.known, self.starts, self.text_starts = 0, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.pool, self.text = np.zeros(0, dtype=np.uint32), np.zeros(8, dtype=np.uint8)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and the first id of each row (rows + 1)."""
        start, end = self._units(data, offsets)
        if not len(start):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
        # At most as many units at a time as the table still takes.
        parts = [self._encode_units(data, start[k : k + MAX_WORDS], end[k : k + MAX_WORDS]) for k in range(0, len(start), MAX_WORDS)]
        bounds = np.concatenate([[0], np.cumsum(np.concatenate([sizes for _, sizes in parts]))])
        return np.concatenate([ids for ids, _ in parts]), bounds[np.searchsorted(start, offsets)]

    def _encode_units(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units, and how many each has."""
        if self.known >= MAX_WORDS:
            self._reset()
        folded = data if self.spaced else LOWER[data]
        short = np.flatnonzero(end - start <= LANE_BYTES)
        names = self.hash.spans(folded, start[short], end[short])
        found = self._find(names)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            self._learn(data, folded, start[short], end[short], names, missing)
            found[missing] = self._find(names[missing])
        # Long units, and those whose hash belongs to another word, go through the library each time.
        at = np.full(len(start), -1, dtype=np.int64)
        at[short] = np.where(self._same(folded, start[short], end[short], found), found, -1)
        alone = np.flatnonzero(at < 0)
        first = self.starts[at]
        sizes = self.starts[at + 1] - first
        extra, sizes[alone] = self._library_ids(data, start[alone], end[alone])
        pooled = int(self.starts[self.known])
        first[alone] = pooled + np.cumsum(sizes[alone]) - sizes[alone]
        self.pool = _with_room(self.pool, pooled + len(extra))
        self.pool[pooled : pooled + len(extra)] = extra
        pool = self.pool
        ends = np.cumsum(sizes)
        return pool[np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1])], sizes

    def _library_ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes() if len(start) else b""
        texts = [raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist())]
        found = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(sizes.sum())), sizes

    def _same(self, folded: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether each unit has the bytes of the word at its place in the table."""
        size, stored = end - start, self.text_starts[at]
        same = self.text_starts[at + 1] - stored == size
        own, known = lanes(folded), lanes(self.text, padded=True)
        live, k = np.flatnonzero(same), 0
        while len(live):
            live = live[size[live] > 8 * k]
            like = lane(own, start[live], size[live], k) == lane(known, stored[live], size[live], k)
            same[live[~like]] = False
            live, k = live[like], k + 1
        return same

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        table = _classes()
        kind = table[data].copy()
        wide = np.flatnonzero(data >= 0x80)
        if len(wide):
            kind[wide] = WHOLE
            lead = wide[(data[wide] >= 0xC2) & (data[wide] < 0xF0)]
            b0 = data[lead].astype(np.int32)
            b1 = data[np.minimum(lead + 1, n - 1)].astype(np.int32) & 0x3F
            b2 = data[np.minimum(lead + 2, n - 1)].astype(np.int32) & 0x3F
            two = b0 < 0xE0
            code = np.where(two, (b0 & 0x1F) << 6 | b1, (b0 & 0x0F) << 12 | b1 << 6 | b2)
            found = table[code]
            kind[lead] = kind[lead + 1] = found
            three = lead[~two] + 2
            kind[three] = found[~two]
        row_first = np.zeros(n + 1, dtype=bool)
        row_first[offsets] = True
        row_first[n] = True
        # Rows that the library must see whole: one unit each.
        odd = kind == WHOLE
        bar = np.flatnonzero(data[:-1] == ord("<"))
        odd[bar[data[bar + 1] == ord("|")]] = True
        whole = np.unique(np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1)
        space = kind == SPACE
        new_segment = row_first[:n].copy()
        new_segment[1:] |= space[1:] != space[:-1]
        # What follows an apostrophe depends on it: such segments are kept in one piece.
        quotes = np.flatnonzero(data == ord("'"))
        if len(quotes):
            heads = np.flatnonzero(new_segment)
            marked = np.zeros(len(heads), dtype=bool)
            marked[np.searchsorted(heads, quotes, side="right") - 1] = True
            kind[np.repeat(marked, np.diff(np.append(heads, n)))] = OTHER
        head = row_first[:n].copy()
        head[1:] |= kind[1:] != kind[:-1]
        start = np.flatnonzero(head)
        end = np.append(start[1:], n)
        gap = space[start]
        if not self.spaced:
            start, end = start[~gap], end[~gap]
        else:
            before = np.maximum(start - 1, 0)
            takes = ~gap & (start > 0) & ~row_first[start] & (data[before] == 0x20) & space[before]
            last_of_row = row_first[end]
            split = gap & ~last_of_row  # the last character of such a gap stands alone or goes to the next word
            begin = np.where(takes, start - 1, start)
            stop = np.where(split, end - 1, end)
            alone = np.flatnonzero(split & (data[end - 1] != 0x20))
            start = np.concatenate([begin, end[alone] - 1])
            end = np.concatenate([stop, end[alone]])
            order = np.argsort(start[start < end], kind="stable")
            start, end = start[start < end][order], end[start < end][order]
        if len(whole):
            row = np.searchsorted(offsets, start, side="right") - 1
            keep = ~np.isin(row, whole)
            start = np.concatenate([start[keep], offsets[whole]])
            end = np.concatenate([end[keep], offsets[whole + 1]])
            order = np.argsort(start, kind="stable")
            start, end = start[order], end[order]
        return start, end

    def _find(self, names: np.ndarray) -> np.ndarray:
        """Index of each name in the pool, or -1."""
        out = np.full(len(names), -1, dtype=np.int64)
        rest = np.arange(len(names))
        slot = (names & np.uint64(self.mask)).astype(np.int64)
        while len(rest):
            key = self.keys[slot]
            hit = key == names[rest]
            out[rest[hit]] = self.index[slot[hit]]
            on = ~hit & (key != 0)
            rest, slot = rest[on], (slot[on] + 1) & self.mask
        return out

    def _learn(self, data: np.ndarray, folded: np.ndarray, start: np.ndarray, end: np.ndarray, names: np.ndarray, missing: np.ndarray) -> None:
        fresh, at = np.unique(names[missing], return_index=True)
        start, end = start[missing[at]], end[missing[at]]
        ids, sizes = self._library_ids(data, start, end)
        value = np.arange(self.known, self.known + len(fresh), dtype=np.int32)
        letters = end - start
        ends = np.cumsum(letters)
        own = folded[np.repeat(start - ends + letters, letters) + np.arange(ends[-1])]
        for name, bounds, added, sums in (("pool", "starts", ids, np.cumsum(sizes)), ("text", "text_starts", own, ends)):
            starts = _with_room(getattr(self, bounds), self.known + 1 + len(fresh))
            filled = int(starts[self.known])
            starts[self.known + 1 : self.known + 1 + len(fresh)] = filled + sums
            values = _with_room(getattr(self, name), filled + len(added) + 8)
            values[filled : filled + len(added)] = added
            setattr(self, bounds, starts)
            setattr(self, name, values)
        self.known += len(fresh)
        slot = (fresh & np.uint64(self.mask)).astype(np.int64)
        while len(fresh):
            free = self.keys[slot] == 0
            _, one = np.unique(slot[free], return_index=True)
            one = np.flatnonzero(free)[one]
            self.keys[slot[one]], self.index[slot[one]] = fresh[one], value[one]
            left = np.ones(len(fresh), dtype=bool)
            left[one] = False
            fresh, value, slot = fresh[left], value[left], (slot[left] + 1) & self.mask


@lru_cache(maxsize=2)
def tokenizer(path: str, spaced: bool) -> WordTokenizer:
    """One per worker process and vocabulary."""
    return WordTokenizer(path, spaced)
