"""Vectorised reading of text columns inside Arrow tasks: words, hashes, batches.

Text stays UTF-8 bytes; a word is a maximal run of bytes that are not ASCII
white space. All spans of a piece are hashed together, eight bytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~_SPACE

#: ASCII letters, and all bytes of characters beyond ASCII.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True

#: Maps A-Z to a-z and all other bytes to themselves.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    if seed:
        x ^= np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Longer spans are hashed one by one.
LANE_BYTES = 64

_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def lanes(data: np.ndarray, padded: bool = False) -> np.ndarray:
    """The eight bytes from each place on as one number. ``padded``: the last
    eight bytes are there only for that; else zeros follow the end."""
    if not padded:
        data = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))


def lane(numbers: np.ndarray, start: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """The k-th eight bytes of spans that have more than 8 k; zeros behind their ends."""
    return numbers[start + 8 * k] & _MASKS[np.minimum(size - 8 * k, 8)]


class SpanHash:
    """Hashes byte spans of a piece; ``seed`` gives independent functions.

    A span is taken in by eight bytes at a time, mixed after each, so that no
    pattern of letters cancels out as it does in sums and polynomials modulo a
    power of two. Spans of more than 64 bytes go through BLAKE2.
    """

    def __init__(self, seed: int):
        self.seed = seed

    def spans(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One hash for each span [start, end) of the bytes."""
        size = end - start
        out = mix(size.astype(np.uint64), self.seed)
        long = np.flatnonzero(size > LANE_BYTES)
        if len(long):
            key = self.seed.to_bytes(8, "little")
            for i, a, b in zip(long.tolist(), start[long].tolist(), end[long].tolist()):
                out[i] = int.from_bytes(blake2b(data[a:b].tobytes(), digest_size=8, key=key).digest(), "little")
        numbers = lanes(data)
        live = np.flatnonzero((size > 0) & (size <= LANE_BYTES))
        k = 0
        while len(live):
            out[live] = mix(out[live] ^ lane(numbers, start[live], size[live], k), self.seed)
            k += 1
            live = live[size[live] > 8 * k]
        return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a missing text is an empty one."""
    column = column.fill_null("").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``size`` bytes together, or of one longer row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def word_spans(
    data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = NOT_SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the first word of each row (rows + 1).

    A word is a maximal run of bytes of ``letters`` in one row."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    inside = letters[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[offsets < n]
    before[edges] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    inner = edges[edges > 0] - 1
    after[inner] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def chain(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of each ``width`` neighbouring values, in order (fewer: none)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64), seed + 11) | np.uint64(1)
    for k in range(width):
        total += hashes[k : k + n] * factors[k]
    return mix(total, seed + 3)


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text"):
    """(rows, bytes, offsets) of one piece after the other."""
    for batch in batches:
        data, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        for first, last in pieces(offsets):
            part = offsets[first : last + 1]
            yield batch.slice(first, last - first), data[part[0] : part[-1]], part - part[0]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def lists(values: np.ndarray, row_starts: np.ndarray) -> pa.Array:
    """List column of 64-bit values, cut at ``row_starts`` (rows + 1)."""
    return pa.ListArray.from_arrays(pa.array(row_starts.astype(np.int32)), signed(values))
