"""Sets of word shingles as sorted 64-bit hashes.

Words are runs of characters other than ASCII white space, A-Z lower-cased. Two different shingles share a hash
with a chance of 2^-64, so a pair of documents with n shingles each is misjudged with a chance below n^2 / 2^64.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers, one for each place in a shingle, and those of the 64-bit finaliser (fixed values).
GOLDEN = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX_1)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words, remembered up to a number of entries that bounds the memory."""

    def __init__(self, most: int = 50_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


class Shingler:
    def __init__(self, width: int):
        self.width, self.words = width, WordHashes()
        self.factors = [np.uint64(pow(GOLDEN, 2 * i + 1, 1 << 64)) for i in range(width)]

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes; of a text of fewer words than the width, one for all; none without words."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(words) < self.width:
            return np.array([xxhash.xxh3_64_intdigest(b"\n".join(words), seed=1)], np.uint64)
        of = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = len(words) - self.width + 1
        total = np.zeros(n, np.uint64)
        for i, factor in enumerate(self.factors):
            total += of[i : i + n] * factor
        return np.unique(mix(total))
