"""The word split of byte-level tokenizers, over whole columns, and a bounded cache of each word's token ids.

The split follows ``public_tokenizers.PATTERN``: contractions, then runs of letters, of numbers and of other
characters with at most one space before them, then white space. Runs are found by comparing the classes of
neighbouring code points, so a text costs a few numpy passes instead of a regular-expression match per word.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa

from watchloom.llm.common import runs

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


@functools.cache
def _classes() -> np.ndarray:
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            lo, hi = ord(m[0][0]), ord(m[0][-1])
            table[lo : hi + 1] = kind
    table[0xD800:0xE000] = OTHER
    return table


def split_words(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of n texts as one binary array, and n + 1 offsets of each text's words."""
    n_texts = len(at) - 1
    if not len(data):
        return pa.array([], pa.large_binary()), np.zeros(n_texts + 1, np.int64)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(points)
    lead = np.arange(n) if n == len(data) else np.flatnonzero((data & 0xC0) != 0x80)
    kind = _classes()[points]
    opens = np.zeros(n + 3, bool)  # where a text begins
    opens[np.searchsorted(lead, at)] = True
    opens[n:] = True
    change = opens[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    begin = np.zeros(n + 3, bool)
    begin[:n] = change
    after = np.flatnonzero(change & (kind != SPACE) & ~opens[:n])
    after = after[kind[after - 1] == SPACE]
    begin[after - 1] = True
    begin[after] = points[after - 1] != 32
    quote = np.flatnonzero((points == 39) & begin[:n] & change)
    if len(quote):
        wide, letters = np.append(points, [0, 0, 0]), np.append(kind, [OTHER] * 3)
        quote = quote[(letters[quote + 1] == LETTER) & ~opens[quote + 1]]
        a, b = wide[quote + 1], np.where(opens[quote + 2], 0, wide[quote + 2])
        one = quote[np.isin(a, [ord(c) for c in "stmd"])]
        two = quote[((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))]
        begin[one + 1], begin[one + 2] = False, True
        begin[two + 1], begin[two + 2], begin[two + 3] = False, False, True
    starts = lead[np.flatnonzero(begin[:n])]
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    )
    return words, np.searchsorted(starts, at)


class WordIds:
    """Token ids of words, remembered up to a number of words; a full cache keeps those that were met again.

    ``encode`` gets a list of new words (bytes) and returns the number of ids of each, and all ids in a row.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 400_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.begin, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.met = np.zeros(0, bool)  # again, since a word came or the cache was last full

    def _make_room(self, wanted: int) -> None:
        kept = np.flatnonzero(self.met)
        if len(kept) + wanted > self.most:
            return self._clear()
        words = list(self.slot)  # in the order of their slots
        self.slot = {words[k]: slot for slot, k in enumerate(kept.tolist())}
        begin, self.count = self.begin[kept], self.count[kept]
        self.flat = self.flat[np.repeat(begin, self.count) + runs(self.count)]
        self.begin, self.met = np.cumsum(self.count) - self.count, np.zeros(len(kept), bool)

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each word, and all ids in a row."""
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.slot) + len(distinct) > self.most:
            self._make_room(len(distinct))
        slots = np.fromiter(map(self.slot.get, distinct, repeat(-1)), np.int64, len(distinct))
        self.met[slots[slots >= 0]] = True
        new = np.flatnonzero(slots < 0)
        if len(new):
            fresh = [distinct[k] for k in new.tolist()]
            counts, flat = self.encode(fresh)
            slots[new] = np.arange(len(self.slot), len(self.slot) + len(new))
            self.slot.update(zip(fresh, slots[new].tolist(), strict=True))
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(counts) - counts])
            self.count = np.concatenate([self.count, counts])
            self.flat = np.concatenate([self.flat, flat])
            self.met = np.append(self.met, np.zeros(len(new), bool))
        slots = slots[coded.indices.to_numpy()]
        counts = self.count[slots]
        return counts, self.flat[np.repeat(self.begin[slots], counts) + runs(counts)]

    def texts(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n + 1 offsets of each text's ids, and all ids in a row."""
        words, woff = split_words(data, at)
        counts, ids = self.ids(words)
        return np.concatenate([[0], np.cumsum(counts)])[woff], ids
