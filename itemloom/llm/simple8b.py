"""Simple-8b: unsigned integers packed into 64-bit words, in blocks that decode by themselves.

The upper four bits of a word are its selector; the rest holds as many values of
as many bits as the selector says. Selectors 0 and 1 stand for 240 and 120
zeros. A value above 60 bits does not fit: it is an escape, kept as a zero in
the words and in full, with its place, in a list of escapes.
"""

from __future__ import annotations

import numpy as np

#: (values, bits) of each selector: fixed values of the format.
LAYOUT = (
    (240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
    (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
COUNTS = np.array([n for n, _ in LAYOUT])
BITS = np.array([b for _, b in LAYOUT])
LIMIT = np.uint64(1 << 60)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    low = values.astype(np.float64)
    width = np.where(values > 0, np.floor(np.log2(np.maximum(low, 1))).astype(np.int64) + 1, 0)
    # The logarithm may round up next to a power of two.
    over = (width > 0) & (values >> np.maximum(width - 1, 0).astype(np.uint64) == 0)
    return width - over


def _selectors(width: np.ndarray, block: int) -> np.ndarray:
    """The selector with the most values that fit, for a word that starts at each place of each block."""
    chosen = np.full((len(width), block), len(LAYOUT) - 1, dtype=np.uint8)
    # Largest width among as many values as a word holds, from each place on: out of the largest of fewer.
    largest, held = width, 1
    for selector in range(len(LAYOUT) - 2, -1, -1):
        count, bits = LAYOUT[selector]
        while held < count:
            step = min(held, count - held)
            largest = np.maximum(largest[:, : largest.shape[1] - step], largest[:, step:])
            held += step
        chosen[largest[:, :block] <= bits] = selector
    return chosen


def encode(values: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, escapes as rows of place and value).

    Blocks of ``block`` values are packed side by side: one step finds the place
    of one word in every block that has values left. A word takes the selector
    with the most values that fit; the last word of a block is filled with zeros.
    """
    values = values.astype(np.uint64)
    out = np.flatnonzero(values >= LIMIT)
    escapes = np.stack([out.astype(np.uint64), values[out]], axis=1)
    values = np.where(values >= LIMIT, np.uint64(0), values)
    n = len(values)
    blocks = -(-n // block)
    # Padding costs no bits, so a word may run over the end of its block.
    padded = np.zeros((blocks, block + 240), dtype=np.uint64)
    flat = np.zeros(blocks * block, dtype=np.uint64)
    flat[:n] = values
    padded[:, :block] = flat.reshape(blocks, block)
    chosen = _selectors(_widths(padded).astype(np.uint8), block)
    size = np.minimum(block, n - np.arange(blocks) * block)
    place, live = np.zeros(blocks, dtype=np.int64), np.arange(blocks)
    rows, places = [], []
    while len(live):
        rows.append(live)
        places.append(place)
        place = place + COUNTS[chosen[live, place]]
        more = place < size[live]
        live, place = live[more], place[more]
    if not rows:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint32), escapes
    rows, places = np.concatenate(rows), np.concatenate(places)
    order = np.argsort(rows, kind="stable")
    rows, places = rows[order], places[order]
    first = np.searchsorted(rows, np.arange(blocks)).astype(np.uint32)
    chosen = chosen[rows, places]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector, (count, bits) in enumerate(LAYOUT):
        own = np.flatnonzero(chosen == selector) if bits else ()
        for k in range(count if len(own) else 0):
            words[own] |= padded[rows[own], places[own] + k] << np.uint64(k * bits)
    return words, first, escapes


def decode(words: np.ndarray, first: np.ndarray, escapes: np.ndarray, n: int, block: int = 512) -> np.ndarray:
    """All ``n`` values: every selector's words at once, placed by the block offsets."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    ends = np.cumsum(counts)
    of_block = np.repeat(np.arange(len(first)), np.diff(np.append(first.astype(np.int64), len(words))))
    before = np.concatenate([[0], ends])[:-1]
    place = before - before[first.astype(np.int64)][of_block] + of_block * block if len(words) else before
    limit = np.minimum((of_block + 1) * block, n)
    values = np.zeros(n, dtype=np.uint64)
    for k in np.unique(selector):
        count, bits = LAYOUT[k]
        if not bits:
            continue
        own = np.flatnonzero(selector == k)
        mask = np.uint64((1 << bits) - 1)
        taken = (words[own][:, None] >> (np.arange(count) * bits).astype(np.uint64)) & mask
        to = place[own][:, None] + np.arange(count)
        inside = to < limit[own][:, None]
        values[to[inside]] = taken[inside]
    if len(escapes):
        values[escapes[:, 0].astype(np.int64)] = escapes[:, 1]
    return values
