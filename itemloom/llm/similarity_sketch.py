"""Fast similarity sketches: hashed bin placement in rounds until all bins are full."""

from __future__ import annotations

import numpy as np

from .words import mix

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_VALUE = np.uint64((1 << 40) - 1)


def fast_similarity_sketch(elements: np.ndarray, owner: np.ndarray, n_owners: int, bins: int) -> np.ndarray:
    """One row of ``bins`` values for each owner of elements.

    In round i < bins every element of a set falls into one hashed bin; round
    bins + j sends all of them to bin j, so 2 * bins rounds leave no bin empty.
    A bin keeps its smallest (round, hash). Two sets agree in a bin with a
    probability equal to their Jaccard similarity, and the sum over the bins is
    concentrated as with as many independent hash functions. An owner leaves
    after the round in which its last bin is filled, so large sets take one or
    two rounds. Owners without elements keep ``EMPTY``.
    """
    sketch = np.full((n_owners, bins), EMPTY, dtype=np.uint64)
    flat = sketch.reshape(-1)
    for turn in range(2 * bins):
        if not len(elements):
            break
        hashed = mix(elements, turn + 101)
        if turn < bins:
            place = ((hashed >> np.uint64(40)) % np.uint64(bins)).astype(np.int64)
        else:
            place = turn - bins
        np.minimum.at(flat, owner * bins + place, (hashed & _VALUE) | np.uint64(turn << 40))
        open_rows = (sketch == EMPTY).any(axis=1)
        more = open_rows[owner]
        elements, owner = elements[more], owner[more]
    return sketch


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` bins; the band is part of it."""
    parts = sketch[:, : bands * rows].reshape(len(sketch), bands, rows)
    total = np.zeros((len(sketch), bands), dtype=np.uint64)
    factors = mix(np.arange(1, rows + 1, dtype=np.uint64), 7) | np.uint64(1)
    for k in range(rows):
        total += mix(parts[:, :, k], k + 1) * factors[k]
    return mix(total + mix(np.arange(bands, dtype=np.uint64), 9), 13)
