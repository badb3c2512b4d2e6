"""Words and word shingles as 64-bit codes."""

from __future__ import annotations

import numpy as np
import xxhash

_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_digest = xxhash.xxh3_64_intdigest


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_digest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * _K[0]
        return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, width: int = 3) -> np.ndarray:
    """The sorted distinct codes of a text's shingles.

    Words are runs other than [\\x20\\x09-\\x0D] with A-Z in lower case; fewer words than ``width`` are one shingle, none are none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: only A-Z change
    if not words:
        return np.empty(0, np.uint64)
    codes = word_codes(words)
    n = len(codes)
    with np.errstate(over="ignore"):
        if n < width:
            h = np.full(1, n, np.uint64)
            for c in codes:
                h = mixed(h * _K[1] + c)
            return h
        h = np.full(n - width + 1, width, np.uint64)
        for k in range(width):
            h = mixed(h * _K[1] + codes[k : n - width + 1 + k])
    return np.unique(h)
