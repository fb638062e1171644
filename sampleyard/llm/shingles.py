"""Word shingles as 64-bit hashes, and MinHash values of them.

Words are the maximal runs of letters, digits and underscores of the lower-cased text.  A
shingle is a run of ``n`` words; a text of one to ``n - 1`` words has its whole word run as its
only shingle, and a text without words has none.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

from .common import mix64

WORD = re.compile(r"\w+")
#: Odd multipliers that give each place in a shingle its own weight.
_PLACE = np.uint64(0x100000001B3)
#: A worker's word cache is emptied at this many words, so it is bounded whatever the corpus.
CACHE_WORDS = 131_072


class WordHashes(dict):
    """Word -> 64-bit hash, filled on demand and bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()


def word_hashes(text: str) -> np.ndarray:
    words = WORD.findall(text.lower())
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(text: str, n: int = 5) -> np.ndarray:
    """Hashes of all shingles in text order, repeats included."""
    h = word_hashes(text)
    if not len(h):
        return h
    width = min(n, len(h))
    out = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        out *= _PLACE
        out += h[k : len(h) - width + 1 + k]
    return mix64(out + np.uint64(width))


def shingle_set(text: str, n: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingle_hashes(text, n))


def multipliers(count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """``count`` pairs (odd multiplier, offset) of the MinHash family."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, count, dtype=np.uint64)
    return a, b


def minhash(hashes: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash values, one row per segment ``hashes[starts[i]:starts[i + 1]]`` (none may be empty)."""
    out = np.empty((len(starts), len(a)), dtype=np.uint64)
    for k in range(len(a)):
        out[:, k] = np.minimum.reduceat(hashes * a[k] + b[k], starts)
    return out
