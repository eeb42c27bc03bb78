"""Words, word hashes and shingles of many texts at once, over their UTF-8 bytes in numpy."""

from __future__ import annotations

import functools

import numpy as np

from watchloom.llm.common import runs

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def _multipliers(power: int) -> np.ndarray:
    # Random 64-bit multipliers, the same for every length: longer tables start like shorter ones.
    return np.random.Generator(np.random.PCG64(0x5EED)).integers(0, 2**64, 1 << power, np.uint64, endpoint=False) | np.uint64(1)


#: Multipliers of the words of a shingle by their place.
_PLACES = np.random.Generator(np.random.PCG64(0xA11CE)).integers(0, 2**64, 64, np.uint64) | np.uint64(1)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased), and n + 1 offsets of each text's words."""
    inside = ~_SPACE[data]
    n = len(data)
    if not inside.any():
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    border = np.zeros(n + 1, bool)
    border[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | border[1:n]
    starts = np.flatnonzero(first)
    places = np.flatnonzero(inside)
    counts = np.diff(np.append(np.searchsorted(places, starts), len(places)))
    rel = runs(counts)
    table = _multipliers(max(12, int(counts.max() - 1).bit_length()))
    begins = np.cumsum(counts) - counts
    sums = np.add.reduceat((_LOWER[data[places]] + np.uint64(1)) * table[rel], begins)
    return mix(sums + counts.astype(np.uint64)), np.searchsorted(starts, at)


def shingle_hashes(words: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles (repeats included) and n + 1 offsets.

    A text of fewer than k words has its whole sequence as the one shingle, an empty text none.
    """
    sizes = np.diff(woff)
    made = np.where(sizes >= k, sizes - k + 1, (sizes > 0).astype(np.int64))
    soff = np.concatenate([[0], np.cumsum(made)])
    where = np.repeat(woff[:-1], made) + runs(made)
    span = np.repeat(np.minimum(sizes, k), made)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    total = span.astype(np.uint64)
    for j in range(k):
        total = total + np.where(span > j, padded[where + j] * _PLACES[j], np.uint64(0))
    return mix(total), soff
