"""A minimal perfect hash over 64-bit keys, built and probed with numpy.

Level by level, keys hash into a bit array twice their number; those alone in their place set the
bit and stay, the others go on to the next level. A key's slot is the number of bits set before its
own. Each slot stores a fingerprint from another hash, so that absent keys are turned away."""

from __future__ import annotations

import numpy as np

U = np.uint64


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(U) + U((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class PerfectHash:
    def __init__(self, sizes: np.ndarray, words: np.ndarray, fingerprints: np.ndarray) -> None:
        """sizes: bits of each level; words: their bits, level after level; fingerprints: uint32 by slot."""
        self.sizes, self.words, self.fingerprints = sizes, words, fingerprints
        self.first = np.concatenate([[0], np.cumsum(sizes // 64)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        """keys: distinct int64."""
        left, sizes, words, level = keys, [], [], 0
        while len(left):
            size = -(-max(64, int(gamma * len(left))) // 64) * 64
            place = mix(left, level) % U(size)
            alone = np.bincount(place.astype(np.int64), minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left, level = left[~alone[place.astype(np.int64)]], level + 1
        out = cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, "<u8"), np.zeros(len(keys), "<u4"))
        out.fingerprints[out.slot(keys)] = cls.fingerprint(keys)
        return out

    @staticmethod
    def fingerprint(keys: np.ndarray) -> np.ndarray:
        return (mix(keys, 1 << 20) >> U(32)).astype("<u4")

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of absent keys any slot, or -1."""
        slots, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            place = (mix(keys[left], level) % U(size)).astype(np.int64)
            at = self.first[level] + place // 64
            bit = (place % 64).astype(U)
            here = (self.words[at] >> bit) & U(1) > 0
            below = self.words[at] & ((U(1) << bit) - U(1))
            slots[left[here]] = (self.before[at] + np.bitwise_count(below))[here]
            left = left[~here]
        return slots

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where the stored fingerprint is another's."""
        slots = self.slot(keys)
        known = slots >= 0
        known[known] = self.fingerprints[slots[known]] == self.fingerprint(keys[known])
        return np.where(known, slots, -1)
