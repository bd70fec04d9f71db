"""Minimal perfect hashing of integer keys, in levels of bit arrays.

Each level hashes the keys left to a bit array with twice as many places; a
key alone at its place is settled there, the others go on to the next level.
A key's index is the number of settled places before its own, counted by a
directory of 64-bit words. (The method of Limasset, Rizk, Chikhi and
Peterlongo, "Fast and scalable minimal perfect hashing for massive key sets",
2017.) Everything is numpy over whole arrays of keys.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Places a key on each level.
SPREAD = 2


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A hash of 64-bit keys (multiply and shift, twice)."""
    h = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass(frozen=True)
class PerfectHash:
    n: int
    #: For each level its bits in words, and how many are set before each word (all levels).
    words: tuple[np.ndarray, ...]
    before: tuple[np.ndarray, ...]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: distinct."""
        words, before, left, total = [], [], keys, 0
        while len(left):
            size = -(-SPREAD * len(left) // 64) * 64
            place = mix(left, len(words)) % np.uint64(size)
            alone = np.bincount(place.astype(np.int64), minlength=size) == 1
            bits = np.packbits(alone, bitorder="little").view("<u8")
            ones = np.bitwise_count(bits).astype(np.int64)
            words.append(bits)
            before.append(total + np.cumsum(ones) - ones)
            total += int(ones.sum())
            left = left[~alone[place]]
        return cls(len(keys), tuple(words), tuple(before))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; a key that is none of those built in may get -1 or any index."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, before) in enumerate(zip(self.words, self.before, strict=True)):
            if not len(left):
                break
            place = mix(keys[left], level) % np.uint64(64 * len(bits))
            at, bit = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            word = bits[at]
            hit = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (before[at] + np.bitwise_count(below).astype(np.int64))[hit]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([self.n, len(self.words), *map(len, self.words)], "<i8")
        return sizes.tobytes() + b"".join(w.tobytes() for w in self.words)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n, levels = np.frombuffer(data, "<i8", 2).tolist()
        sizes = np.frombuffer(data, "<i8", levels, 16).tolist()
        words, before, at, total = [], [], 8 * (2 + levels), 0
        for size in sizes:
            bits = np.frombuffer(data, "<u8", size, at)
            ones = np.bitwise_count(bits).astype(np.int64)
            words.append(bits)
            before.append(total + np.cumsum(ones) - ones)
            total += int(ones.sum())
            at += 8 * size
        return cls(n, tuple(words), tuple(before))
