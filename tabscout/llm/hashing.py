"""64-bit hashes of words and of runs of words, for whole texts at a time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import xxhash

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_FINAL = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SHIFTS = (np.uint64(30), np.uint64(27), np.uint64(31))


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> _SHIFTS[0])) * _FINAL[0]
    x = (x ^ (x >> _SHIFTS[1])) * _FINAL[1]
    return x ^ (x >> _SHIFTS[2])


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of ``n`` consecutive word hashes; empty if there are fewer."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(count, np.uint64(n))
    for j in range(n):
        total = (total ^ words[j : j + count]) * _PRIME
        total ^= total >> _SHIFTS[2]
    return mixed(total)


class WordHashes:
    """Hashes of words, remembered until there are ``limit`` of them."""

    def __init__(self, limit: int = 200_000):
        self._known: dict[bytes, int] = {}
        self._limit = limit

    def __call__(self, words: Sequence[bytes]) -> np.ndarray:
        known = self._known
        if len(known) > self._limit:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    """One memory of words per Python worker."""
    return WordHashes()


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words of a text, A to Z lowered.

    Words are what ASCII white space separates. Fewer than ``n`` words are one
    run; no words, or a null text, give none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(run_hashes(word_hashes()(words), min(n, len(words))))
