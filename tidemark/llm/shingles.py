"""Hashed sets of word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import CACHE_BYTES, KEPT_LENGTH

SHINGLE = 5
P, Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Words(dict):
    """64-bit hashes of words of up to KEPT_LENGTH bytes, kept between texts up to CACHE_BYTES."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= KEPT_LENGTH:
            if self.held > CACHE_BYTES:
                self.clear()
                self.held = 0
            self[word] = value
            self.held += 200 + len(word)
        return value


_words = _Words()


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; of the whole sequence if it has fewer words; none without words.

    Words are what [\\x20\\x09-\\x0D] separates, with A-Z in lower case, which is what bytes.lower() and bytes.split() do.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for i in range(width):
        h = h * P + w[i : len(w) - width + 1 + i]
    h ^= h >> np.uint64(29)
    h *= Q
    h ^= h >> np.uint64(32)
    return np.unique(h)
