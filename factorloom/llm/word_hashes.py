"""64-bit names of words and of their sequences, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

CACHED_WORDS = 500_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32, _S33 = np.uint64(29), np.uint64(32), np.uint64(33)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of the ordered pair of two names, position by position."""
    x = a * _A + _C
    x ^= x >> _S32
    x = (x + b) * _B
    x ^= x >> _S29
    x *= _C
    x ^= x >> _S33
    return x


def windows(names: np.ndarray, size: int) -> np.ndarray:
    """Names of all windows of ``size`` consecutive names, by doubling."""
    if len(names) < size:
        return names[:0]
    span, out = 1, names
    while 2 * span <= size:
        out = mix(out[:-span], out[span:])
        span *= 2
    rest = size - span
    return mix(out[: len(names) - size + 1], out[rest:]) if rest else out


class WordHashes(dict):
    """Hashes of words, with a bounded cache per worker."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHED_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
