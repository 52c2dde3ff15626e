"""The binary Golay code (23, 12, distance 7) and fuzzy keys from it.

The code is perfect: every 23-bit word lies within distance 3 of exactly one codeword.  The
keys of a word are its codeword's 12-bit index and, when the word is at distance 3 from it,
also the indices of the five codewords at distance 4.  Then for any two words that differ in
at most one bit, the *first* key of one is among the keys of the other:

* at distance 2 or less from the codeword, the neighbour is at 3 or less from the same one;
* at distance 3, the neighbour is at distance 2 of it, or at distance 4; and then its own
  codeword is at distance 3 from it, hence at distance 4 from the word.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: fixed value: generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
GENERATOR = 0xAE3
#: most keys of a word
KEYS = 6


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits of a word; error patterns of each syndrome (the
    leader first, then the patterns of weight 4, -1 where there is none)."""
    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    unit = [remainder(1 << i) for i in range(23)]

    def linear(bits: list[int]) -> np.ndarray:
        out = np.zeros(1, np.int64)
        for syndrome in bits:
            out = np.concatenate([out, out ^ syndrome])
        return out

    patterns = np.full((2048, KEYS), -1, np.int64)
    used = np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            syndrome = 0
            for i in bits:
                syndrome ^= unit[i]
            if weight < 4 or patterns[syndrome, 0].item().bit_count() == 3:
                patterns[syndrome, used[syndrome]] = sum(1 << i for i in bits)
                used[syndrome] += 1
    return linear(unit[:12]), linear(unit[12:]), patterns


def keys(words: np.ndarray) -> np.ndarray:
    """Key indices of 23-bit words, shape (n, 6): nearest codeword first, -1 where unused."""
    low, high, patterns = _tables()
    words = words.astype(np.int64)
    found = patterns[low[words & 0xFFF] ^ high[words >> 12]]
    return np.where(found < 0, -1, (words[:, None] ^ found) >> 11)
