"""Sets of word shingles as sorted 64-bit hashes.

Two different shingles of one corpus of 10^12 share a hash with a probability
of about 2^-64 each pair compared; sets are compared by these hashes.
"""

from __future__ import annotations

import numpy as np
import xxhash
import zstandard

from .common import words

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(values: np.ndarray) -> bytes:
    """Numbers, their bytes by plane, compressed."""
    return zstandard.compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes(), 1) if len(values) else b""


def unpack(blob: bytes, kind: type) -> np.ndarray:
    if not blob:
        return np.empty(0, kind)
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).reshape(-1).view(kind)


class Shingler:
    """Distinct shingles of a text; hashes of words are remembered."""

    def __init__(self, width: int, limit: int = 400_000):
        self.width, self.limit = width, limit
        self.known: dict[bytes, int] = {}

    def word_hashes(self, tokens: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        out = list(map(known.get, tokens))
        if None in out:
            digest = xxhash.xxh3_64_intdigest
            for k, h in enumerate(out):
                if h is None:
                    out[k] = known[tokens[k]] = digest(tokens[k])
        return np.array(out, np.uint64)

    def of(self, text: str | None) -> np.ndarray:
        """Sorted hashes of the distinct shingles.

        A text of fewer words than the width is one shingle of all its words; a
        text without words has none.
        """
        tokens = words(text)
        if not tokens:
            return np.empty(0, np.uint64)
        h = self.word_hashes(tokens)
        wide = min(self.width, len(h))
        n = len(h) - wide + 1
        total = np.full(n, wide, np.uint64)
        for k in range(wide):
            total += h[k : k + n] * _ODD[k]
        return np.unique(mix(total))
