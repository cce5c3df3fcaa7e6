"""The perfect binary Golay code (23, 12, 7), and fuzzy hashing with it.

Every 23-bit word is within distance 3 of exactly one of the 4096 codewords. Fuzzy
hashing (Yu, Berkovich et al.) gives a word the indices of all codewords within
distance 4: one if its nearest is at distance 2 or less, else six. Two words that
differ in one bit then share an index: if their nearest codewords differ, these are
at least 7 apart, so both words are at distance 3 of their own and thus within 4 of the
other's.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

BITS, CHECK_BITS, KEYS = 23, 11, 6
#: The generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
LOW = 12


def remainder(word: int) -> int:
    """``word`` modulo the generator, over GF(2)."""
    for k in range(BITS - 1, CHECK_BITS - 1, -1):
        if word >> k & 1:
            word ^= GENERATOR << (k - CHECK_BITS)
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and the error patterns of each syndrome, the lightest first, -1 where there are no more."""
    unit = [remainder(1 << k) for k in range(BITS)]
    low, high = np.zeros(1 << LOW, np.int32), np.zeros(1 << (BITS - LOW), np.int32)
    for part, first in ((low, 0), (high, LOW)):
        for k in range(len(part).bit_length() - 1):
            part[1 << k : 2 << k] = part[: 1 << k] ^ unit[first + k]
    patterns = np.full((1 << CHECK_BITS, KEYS), -1, np.int32)
    used = np.zeros(1 << CHECK_BITS, np.int32)
    for weight in range(5):
        for places in combinations(range(BITS), weight):
            syndrome = 0
            for k in places:
                syndrome ^= unit[k]
            patterns[syndrome, used[syndrome]] = sum(1 << k for k in places)
            used[syndrome] += 1
    return low, high, patterns


def indices(words: np.ndarray) -> np.ndarray:
    """The codeword indices of each word, ``KEYS`` a row, -1 where there are fewer."""
    low, high, patterns = tables()
    words = words.astype(np.int64)
    errors = patterns[low[words & ((1 << LOW) - 1)] ^ high[words >> LOW]]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> CHECK_BITS)
