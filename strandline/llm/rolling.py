"""Hashes of spans of a symbol sequence, by doubling, and window minimisers, in numpy.

A sequence is an array of 64-bit symbol values. ``Levels`` keeps the hash of every span of 1, 2, 4, ... symbols: that of a longer span is
mixed from those of its two halves, and that of a span of any length from the two longest such spans that together cover it.
No step is linear, so no family of texts collides by construction, as under polynomial hashes modulo 2**64. Equal spans have equal
hashes wherever they stand; two salts give two independent 64-bit values.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash

FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
LENGTH_FACTOR = np.uint64(0x165667B19E3779F9)
WORD_SEED = 0x5EED


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit mixing function, so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_values(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, by its bytes."""
    digest = xxhash.xxh3_64_intdigest
    known = {w: digest(w, WORD_SEED) for w in set(words)}
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def distinct_values(words: list[bytes]) -> np.ndarray:
    """As ``word_values``, of words that differ."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(WORD_SEED)), np.uint64, len(words))


class Levels:
    """``raw`` is an array of 64-bit values, or of bytes, whose spans of up to 8 are kept as they are."""

    def __init__(self, raw: np.ndarray, salt: int = 0):
        self.n, self.factor = len(raw), FACTORS[salt]
        self.exact = 8 if raw.dtype == np.uint8 else 1
        self.levels = [raw.astype(np.uint64)]

    def _join(self, left: np.ndarray, right: np.ndarray, length=None) -> np.ndarray:
        out = left * self.factor
        out += right
        if length is not None:
            out += length * LENGTH_FACTOR
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xFF51AFD7ED558CCD)
        return out

    def level(self, k: int) -> np.ndarray:
        """The hash of every span of 2**k symbols."""
        while len(self.levels) <= k:
            have, size = self.levels[-1], 1 << (len(self.levels) - 1)
            left, right = have[: max(0, len(have) - size)], have[size:]
            if 2 * size <= self.exact:
                self.levels.append(left | (right << np.uint64(8 * size)))
            else:
                self.levels.append(self._join(left, right, np.array([2 * size], np.uint64) if size == self.exact else None))
        return self.levels[k]

    def all(self, length: int) -> np.ndarray:
        """The hash of every span of this length."""
        count = self.n - length + 1
        if count <= 0:
            return np.zeros(0, np.uint64)
        k = length.bit_length() - 1
        have, size = self.level(k), 1 << k
        return have[:count] if size == length else self._join(have[:count], have[length - size : length - size + count], np.array([length], np.uint64))

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The hash of each span [start, stop); none is empty."""
        length = (stop - start).astype(np.int64)
        out = np.zeros(len(length), np.uint64)
        power = np.frexp(length)[1] - 1
        for k in np.unique(power).tolist():
            own = np.flatnonzero(power == k)
            have, a = self.level(k), start[own]
            found = self._join(have[a], have[stop[own] - (1 << k)], length[own].astype(np.uint64))
            out[own] = np.where(length[own] == 1 << k, have[a], found)
        return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def anchors(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For windows of ``width`` consecutive grams: the anchor (leftmost gram of least hash) of each run
    of windows that have the same one, and the run's first and last window. Equal windows have their
    anchor at the same place, wherever they stand."""
    if len(grams) < width:
        none = np.zeros(0, np.int64)
        return none, none, none
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    owner = (sliding_min(key, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(owner[1:] != owner[:-1]) + 1))
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], first, last
