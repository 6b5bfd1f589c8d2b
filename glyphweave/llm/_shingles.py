"""Word shingles of whole texts as sorted 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return (x ^ (x >> np.uint64(29))) * _ODD


def word_hashes(text: bytes) -> np.ndarray:
    """One hash for each word; A-Z count as a-z. bytes.split() parts at the six ASCII spaces."""
    words = text.lower().split()
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles; of a shorter text the whole sequence is one; none without words."""
    h = word_hashes(text or b"")
    if not len(h):
        return h
    n = min(n, len(h))
    s = h[: len(h) - n + 1]
    for j in range(1, n):
        s = mix(s) + h[j : len(h) - n + 1 + j]
    return np.unique(mix(s + np.uint64(n)))
