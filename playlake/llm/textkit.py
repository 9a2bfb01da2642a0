"""Vectorised word hashing shared by the Python-side operators.

Words come from ``bytes.split()``, whose separators are exactly U+0009..U+000D and U+0020, and
``bytes.lower()`` changes A-Z only, so both follow the contracts without regular expressions.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Entries that a worker's word cache may hold before it starts afresh.
CACHE_WORDS = 100_000

#: Odd multipliers of the n-gram polynomials, 3 modulo 8.
GRAM_BASE = np.uint64(0x9E3779B97F4A7C1B)
SECOND_BASE = np.uint64(0xC2B2AE3D27D4EB53)


class WordHashes(dict):
    """Maps a word to its 64-bit hash and computes it when it is first seen."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = WordHashes()


def hashes_of(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, in order."""
    return np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))


Batches = Iterator[pa.RecordBatch]
_caches: dict[str, dict] = {"words": _words}


def worker_cache(name: str) -> dict:
    """What an operator keeps in a worker from one task to the next; tasks of other operators empty it."""
    return _caches.setdefault(name, {})


def give_back(own: str = "") -> None:
    """Return a worker's memory to the system, all but the cache named `own`.

    Workers outlive the operator that used them, and Arrow's pool and the C library hold on to freed memory.
    """
    for name, cache in _caches.items():
        if name != own:
            cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc only
        trim(0)


def tidied(run: Callable[[Batches], Batches], own: str = "") -> Callable[[Batches], Batches]:
    """`run`, after which the worker gives its memory back at the end of each task."""

    def over(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back(own)

    return over


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit of 64-bit values (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(w: np.ndarray, n: int, base: np.uint64 = GRAM_BASE) -> np.ndarray:
    """Hashes of all runs of `n` words, ``len(w) - n + 1`` of them, by doubling the run length."""
    if len(w) < n:
        return np.empty(0, np.uint64)
    power, length, built, part = base, 1, None, w
    built_len = 0
    rest = n
    while rest:
        if rest & 1:
            if built is None:
                built, built_len = part, length
            else:  # `part` runs come first, then the shorter ones built so far
                m = min(len(part), len(built) - length)
                scale = _pow(base, built_len)
                built = part[:m] * scale + built[length : length + m]
                built_len += length
        rest >>= 1
        if rest:
            part = part[:-length] * power + part[length:]
            power = _pow(power, 2)
            length *= 2
    return mix(built)


def _pow(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))
