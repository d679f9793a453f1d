"""Minimal perfect hashing for bounded key sets: levels of collision-free bits with rank lookups.

Every level hashes the keys left over into a bit array; keys that are alone in their bit stay there, the others go
to the next level. A key's slot is the rank of its bit over all levels: n keys get the slots 0..n-1. Keys are rows of
64-bit lanes, hashed anew with each level's seed, so that only equal keys can collide for ever.
"""

from __future__ import annotations

import io

import numpy as np

from tapeloom.llm.common import mix64

GAMMA = 1.5  # bits per key and level
MAX_LEVELS = 64


def lane_hash(keys: np.ndarray, seed: int) -> np.ndarray:
    """One 64-bit hash of each row of an (n, lanes) uint64 array."""
    h = mix64(keys[:, 0], seed)
    for k in range(1, keys.shape[1]):
        h = mix64(keys[:, k] ^ h, seed + k)
    return h


class Mphf:
    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = []
        below = 0
        for bits in levels:
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])
            self.ranks.append(ones[:-1] + below)
            below += int(ones[-1])
        self.size = below

    @classmethod
    def build(cls, keys: np.ndarray) -> Mphf:
        """keys: (n, lanes) uint64 rows, all different."""
        levels, left = [], keys
        while len(left):
            if len(levels) == MAX_LEVELS:
                raise ValueError("a minimal perfect hash needs distinct keys")
            m = max(64, int(np.ceil(len(left) * GAMMA / 64)) * 64)
            at = (lane_hash(left, len(levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m)[at] == 1
            bits = np.zeros(m // 64, np.uint64)
            np.bitwise_or.at(bits, at[alone] >> 6, np.uint64(1) << (at[alone] & 63).astype(np.uint64))
            levels.append(bits)
            left = left[~alone]
        return cls(levels)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key; -1 for some keys that are not members (others get any slot, so compare what is stored there)."""
        slots = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(todo):
                break
            at = (lane_hash(keys[todo], level) % np.uint64(len(bits) * 64)).astype(np.int64)
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            slots[todo[hit]] = (ranks[at >> 6] + below)[hit]
            todo = todo[~hit]
        return slots

    def dump(self) -> bytes:
        out = io.BytesIO()
        out.write(np.array([len(self.levels), *map(len, self.levels)], "<u4").tobytes())
        for bits in self.levels:
            out.write(bits.astype("<u8").tobytes())
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> Mphf:
        n = int(np.frombuffer(blob, "<u4", 1)[0])
        sizes, at, levels = np.frombuffer(blob, "<u4", n, 4), 4 + 4 * n, []
        for size in sizes:
            levels.append(np.frombuffer(blob, "<u8", int(size), at).astype(np.uint64))
            at += 8 * int(size)
        return cls(levels)
