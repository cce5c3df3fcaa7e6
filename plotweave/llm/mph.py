"""Minimal perfect hashing of 128-bit keys, vectorised.

The construction is the cascade of collision-free bit arrays of Limasset, Rizk,
Chikhi and Peterlongo (2017): a level hashes the remaining keys into a bit array,
keeps the keys that are alone in their place, and passes the others on. A key's
index is the number of set bits before its own. About four bits a key.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# The multipliers of the splitmix64 finaliser and its golden-ratio step.
M1, M2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
GAMMA = 1.6
WORD = 64


def mixed(high: np.ndarray, low: np.ndarray, level: int) -> np.ndarray:
    """A hash of both halves, another one for each level."""
    odd = np.uint64((2 * level + 1) * STEP % 2**64 | 1)
    x = high + low * odd
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


@dataclass
class PerfectHash:
    """Maps each of ``n`` known keys to its own index below ``n``; other keys to any index or -1."""

    n: int
    words: list[np.ndarray]
    before: list[np.ndarray]

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        """The keys must be distinct."""
        n, total, words, before = len(high), 0, [], []
        while len(high):
            size = max(1, int(GAMMA * len(high) / WORD) + 1) * WORD
            at = mixed(high, low, len(words)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size)[at] == 1
            bits = np.zeros(size, np.uint8)
            bits[at[alone]] = 1
            packed = np.packbits(bits, bitorder="little").view("<u8")
            counts = np.bitwise_count(packed).astype(np.int64)
            before.append((total + np.cumsum(counts) - counts).astype(np.uint32))
            words.append(packed)
            total += int(counts.sum())
            high, low = high[~alone], low[~alone]
        return cls(n, words, before)

    def index(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        out = np.full(len(high), -1, np.int64)
        left = np.arange(len(high))
        for level, (packed, counts) in enumerate(zip(self.words, self.before, strict=True)):
            if not len(left):
                break
            at = mixed(high[left], low[left], level) % np.uint64(len(packed) * WORD)
            word, bit = packed[at // np.uint64(WORD)], at % np.uint64(WORD)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = counts[(at[hit] // np.uint64(WORD)).astype(np.int64)] + np.bitwise_count(below)
            left = left[~hit]
        return out

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (*self.words, *self.before))
