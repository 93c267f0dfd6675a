"""Recompression of word sequences: rounds that name runs, then pairs.

A round first turns every maximal run of one symbol into a symbol, then splits
all symbols into left and right ones by a hashed bit and turns each left symbol
that is followed by a right one into a symbol of both. The name of a symbol is a
hash of what it stands for, the same in every task, so equal sequences get equal
symbols in their interior; only symbols near their ends depend on what stands
around them. ``lo`` and ``hi`` tell which words a symbol depends on.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from .words import mix

_RUN = np.uint64(0x9DDFEA08EB382D69)
_LEFT = np.uint64(0xA0761D6478BD642F)
_RIGHT = np.uint64(0xE7037ED1A0B428DB)


@dataclass
class Symbols:
    """Symbols of many rows; words are counted over all rows."""

    name: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    lo: np.ndarray | None = None
    hi: np.ndarray | None = None

    @classmethod
    def of_words(cls, words: np.ndarray, row: np.ndarray, depends: bool) -> Symbols:
        """``depends``: keep track of lo and hi, too."""
        at = np.arange(len(words))
        return cls(words, row, at, at + 1, *((at, at + 1) if depends else ()))

    def with_runs(self) -> Symbols:
        n = len(self.name)
        if not n:
            return self
        head = np.empty(n, dtype=bool)
        head[0] = True
        head[1:] = (self.name[1:] != self.name[:-1]) | (self.row[1:] != self.row[:-1])
        at = np.flatnonzero(head)
        last = np.append(at[1:], n) - 1
        length = (last - at + 1).astype(np.uint64)
        name = np.where(length > 1, mix(self.name[at] * _RUN + length), self.name[at])
        if self.lo is None:
            return Symbols(name, self.row[at], self.start[at], self.end[last])
        # That a run ends depends on its neighbours; the end of a text is no part of any window.
        lo = np.where(self._first(at), self.start[at] - 1, self.lo[at - 1])
        hi = np.where(self._final(last), self.end[last] + 1, self.hi[np.minimum(last + 1, n - 1)])
        return Symbols(name, self.row[at], self.start[at], self.end[last], lo, hi)

    def with_pairs(self, turn: int) -> tuple[Symbols, np.ndarray]:
        """The next symbols, and which of them are new pairs."""
        n = len(self.name)
        if not n:
            return self, np.zeros(0, dtype=bool)
        right = (mix(self.name, 31 + turn) & np.uint64(1)).astype(bool)
        joins = np.zeros(n, dtype=bool)  # a left symbol before a right one
        joins[:-1] = ~right[:-1] & right[1:] & (self.row[1:] == self.row[:-1])
        joined = np.zeros(n, dtype=bool)
        joined[1:] = joins[:-1]
        keep = np.flatnonzero(~joined)
        pair = joins[keep]
        mate = np.minimum(keep + 1, n - 1)
        name = self.name[keep]
        name[pair] = mix(name[pair] * _LEFT + self.name[mate[pair]] * _RIGHT)
        end = np.where(pair, self.end[mate], self.end[keep])
        if self.lo is None:
            return Symbols(name, self.row[keep], self.start[keep], end), pair
        # An unpaired symbol depends on the neighbour it might have been paired with.
        at = np.arange(n)
        before = np.where(self._first(at), self.start - 1, self.lo[at - 1])
        after = np.where(self._final(at), self.end + 1, self.hi[np.minimum(at + 1, n - 1)])
        lo = np.where(right & ~joined, np.minimum(before, self.lo), self.lo)
        hi = np.where(~right & ~joins, np.maximum(after, self.hi), self.hi)
        high = np.where(pair, np.maximum(hi[keep], hi[mate]), hi[keep])
        low = np.where(pair, np.minimum(lo[keep], lo[mate]), lo[keep])
        return Symbols(name, self.row[keep], self.start[keep], end, low, high), pair

    def _first(self, at: np.ndarray) -> np.ndarray:
        return (at == 0) | (self.row[at] != self.row[at - 1])

    def _final(self, at: np.ndarray) -> np.ndarray:
        n = len(self.row)
        return (at == n - 1) | (self.row[at] != self.row[np.minimum(at + 1, n - 1)])


_PRIME = (1 << 61) - 1


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for any 64-bit x."""
    x = (x & np.uint64(_PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(_PRIME), x - np.uint64(_PRIME), x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it, from halves that fit 64 bits."""
    low = np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> np.uint64(31), a & low, b >> np.uint64(31), b & low
    middle = a1 * b0 + a0 * b1
    middle_low = (middle & np.uint64((1 << 30) - 1)) << np.uint64(31)
    return _reduced(_reduced((a1 * b1 << np.uint64(1)) + (middle >> np.uint64(30)) + middle_low) + a0 * b0)


class _Powers:
    """Powers of a number modulo the prime, as many as were asked for so far."""

    def __init__(self, base: int):
        self.base, self.found = base, np.ones(1, dtype=np.uint64)

    def first(self, n: int) -> np.ndarray:
        while len(self.found) < n:
            step = np.uint64(pow(self.base, len(self.found), _PRIME))
            self.found = np.concatenate([self.found, _times(self.found, step)])
        return self.found[:n]


@lru_cache(maxsize=4)
def _bases(seed: int) -> tuple[_Powers, _Powers]:
    base = int(mix(np.array([seed], dtype=np.uint64), 3)[0]) % (_PRIME - 1) + 1
    return _Powers(base), _Powers(pow(base, -1, _PRIME))


class Sequences:
    """Two hashes of any span of words, from prefix sums of polynomials modulo a
    prime with a base each. ``more`` are second hashes of the words, so that the
    two have nothing in common from the bytes up."""

    def __init__(self, words: np.ndarray, more: np.ndarray):
        self.parts = []
        for own, seed in ((words, 51), (more, 52)):
            powers, inverses = (p.first(len(own) + 1) for p in _bases(seed))
            terms = _times(_reduced(own), powers[:-1])
            sums = np.zeros(len(own) + 1, dtype=np.uint64)
            low = np.cumsum(terms & np.uint64((1 << 32) - 1), dtype=np.uint64)
            high = np.cumsum(terms >> np.uint64(32), dtype=np.uint64)
            sums[1:] = _reduced(_times(_reduced(high), np.uint64(1 << 32)) + _reduced(low))
            self.parts.append((sums, inverses, seed))

    def spans(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        sums, inverses, seed = self.parts[which]
        inside = _reduced(sums[end] + np.uint64(_PRIME) - sums[start])
        return mix(_times(inside, inverses[start]) ^ (end - start).astype(np.uint64) << np.uint64(40), seed)


def long_symbols(words: np.ndarray, row: np.ndarray, rounds: int) -> Symbols:
    symbols = Symbols.of_words(words, row, depends=False)
    for turn in range(rounds):
        symbols = symbols.with_runs().with_pairs(turn)[0]
    return symbols


def window_anchors(words: np.ndarray, first: np.ndarray, width: int, rounds: int, sequences: Sequences):
    """For each window of ``width`` words of one row: its first word, row, and
    the name of the symbol it is found by.

    A window may be found by a symbol only if all words that the symbol depends
    on are inside, so every occurrence of a window finds the same one: of the
    latest round, and there the one with the smallest hash of these words. A
    window without such a symbol is found by its word of the smallest hash.
    """
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    starts = np.maximum(counts - width + 1, 0)
    window_row = np.repeat(np.arange(len(counts)), starts)
    window = np.arange(len(window_row)) + np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(starts)[:-1]]), starts)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full(len(words) + 1, none, dtype=np.uint64)
    symbols = Symbols.of_words(words, row, depends=True)
    for turn in range(rounds):
        symbols, new = symbols.with_runs().with_pairs(turn)
        spare = symbols.lo - (symbols.hi - width)
        usable = np.flatnonzero(new & (spare >= 0))
        usable = usable[symbols.hi[usable] <= first[symbols.row[usable] + 1]]
        usable = usable[symbols.lo[usable] >= first[symbols.row[usable]]]
        lo, hi, spare = symbols.lo[usable], symbols.hi[usable], spare[usable]
        rank = np.uint64(rounds - turn) << np.uint64(60)
        key = (sequences.spans(lo, hi) >> np.uint64(4)) | rank
        for shift in range(width):
            some = spare >= shift
            if not some.any():
                break
            place = hi[some] - width + shift
            inside = place >= 0
            np.minimum.at(best, place[inside], key[some][inside])
    found = best[window]
    rest = np.flatnonzero(found == none)
    if len(rest):
        least = mix(words[window[rest]], 71)
        for k in range(1, width):
            least = np.minimum(least, mix(words[window[rest] + k], 71))
        found[rest] = (least >> np.uint64(4)) | (np.uint64(rounds + 1) << np.uint64(60))
    return window, window_row, found
