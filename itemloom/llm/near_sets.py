"""Word shingles of documents as sets of 64-bit hashes, computed in Arrow tasks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .words import LOWER, SpanHash, chain, mix, word_spans


@lru_cache(maxsize=4)
def _hash(seed: int) -> SpanHash:
    return SpanHash(seed)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one row after the other, and
    the first element of each row (rows + 1).

    A row of fewer than ``width`` words has its whole sequence as its only
    shingle; a row without words has none. A-Z count as a-z.
    """
    data = LOWER[data]
    start, end, first = word_spans(data, offsets)
    hasher = _hash(5)
    words = hasher.spans(data, start, end)
    grams = chain(words, width)
    sets = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            own = np.sort(grams[a : b - width + 1])
            keep = np.empty(len(own), dtype=bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            sets.append(own[keep])
        elif b > a:
            sets.append(chain(words[a:b], int(b - a), seed=int(b - a)))
        else:
            sets.append(words[:0])
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    return (np.concatenate(sets) if sets else words[:0]), np.concatenate([[0], np.cumsum(sizes)])


def digests(elements: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each row's set; equal sets have equal ones."""
    out = []
    for seed in (21, 22):
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(elements, seed), dtype=np.uint64)])
        out.append(mix(sums[first[1:]] - sums[first[:-1]], seed))
    return out[0], out[1]
