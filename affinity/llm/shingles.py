"""Word shingles of texts as sorted sets of 64-bit hashes, and their MinHash values."""

from __future__ import annotations

import numpy as np
import xxhash

#: Word hashes in each of the two generations that a Python worker keeps.
KEPT_WORDS = 60_000
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


class _WordHashes(dict):
    """When full it becomes the old generation, from which words in use come back."""

    def __init__(self):
        super().__init__()
        self.old: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> int:
        h = self.old.get(word)
        if h is None:
            h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= KEPT_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = h
        return h


_WORDS = _WordHashes()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> _S)) * _M1
    h = (h ^ (h >> _S)) * _M2
    return h ^ (h >> _S)


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at \\x20 and \\x09-\\x0D (what bytes methods do)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(text: str | None) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``width`` words; fewer words make one shingle, none make none."""
    w = word_hashes(text)
    if not len(w):
        return w
    runs = min(width, len(w))
    n = len(w) - runs + 1
    h = np.full(n, np.uint64(runs))
    factor = 0x9E3779B97F4A7C15
    for k in range(runs):
        h += w[k : k + n] * np.uint64(factor)
        factor = factor * 0xD1342543DE82EF95 % 2**64
    return np.unique(mixed(h))


class MinHasher:
    """``n`` universal hash functions x -> a*x + b mod 2^32 with odd a, and their minima."""

    def __init__(self, n: int, seed: int = 1):
        r = np.random.default_rng(seed)
        self.a = r.integers(0, 2**31, n, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
        self.b = r.integers(0, 2**32, n, dtype=np.uint32)[:, None]

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 2**32 - 1, np.uint32)
        for k in range(0, len(x), 1024):
            np.minimum(least, (self.a * x[None, k : k + 1024] + self.b).min(axis=1), out=least)
        return least


def band_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each run of ``rows`` minima; the band's number is part of it."""
    m = minima.reshape(-1, rows).astype(np.uint64)
    h = np.arange(1, len(m) + 1, dtype=np.uint64) * _M2
    for k in range(rows):
        h = mixed(h ^ m[:, k]) + m[:, k]
    return mixed(h).view(np.int64)
