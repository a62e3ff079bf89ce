"""Minimal perfect hash over 64-bit keys with stored fingerprints (level-wise bit arrays, rank by popcount)."""

from __future__ import annotations

import numpy as np

from .common import mix64, pack_arrays, unpack_arrays

LEVELS = 48
GOLDEN = 0x9E3779B97F4A7C15


def _hash(keys: np.ndarray, level: int) -> np.ndarray:
    return mix64(keys + np.uint64(GOLDEN * (2 * level + 1) & 0xFFFFFFFFFFFFFFFF))


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, LEVELS + 1) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """``lookup(keys)`` gives each known key its own slot in 0..n-1, and -1 where the stored fingerprint differs.

    An unknown key is taken for a known one with probability 2**-32. Keys must be distinct.
    """

    def __init__(self, sizes, words, ranks, prints):
        self.sizes, self.words, self.ranks, self.prints = sizes, words, ranks, prints
        self.bases = np.r_[0, np.cumsum(sizes)].astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> "PerfectHash":
        keys = np.asarray(keys).astype(np.uint64)
        sizes, words, left, level = [], [], keys, 0
        while len(left):
            if level == LEVELS:
                raise ValueError("keys are not distinct")
            size = max(64, -(-int(len(left) * gamma) // 64) * 64)
            at = (_hash(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left, level = left[~alone[at]], level + 1
        bits = np.concatenate(words) if words else np.zeros(0, "<u8")
        ranks = np.r_[0, np.cumsum(np.bitwise_count(bits).astype(np.int64))][:-1].astype("<u4") if len(bits) else np.zeros(0, "<u4")
        made = cls(np.array(sizes, "<u4"), bits, ranks, np.zeros(len(keys), "<u4"))
        if len(keys):
            made.prints[made._slots(keys)] = _fingerprint(keys)
        return made

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys).astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = (_hash(keys[open_], level) % np.uint64(size)).astype(np.int64) + self.bases[level]
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (self.ranks[word] + np.bitwise_count(below))[hit]
            open_ = open_[~hit]
        return out

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys).astype(np.uint64)
        out = self._slots(keys)
        known = out >= 0
        known[known] = self.prints[out[known]] == _fingerprint(keys[known])
        return np.where(known, out, -1)

    def to_bytes(self) -> bytes:
        return pack_arrays({"sizes": self.sizes, "words": self.words, "ranks": self.ranks, "prints": self.prints})

    @classmethod
    def from_bytes(cls, blob: bytes) -> "PerfectHash":
        a = unpack_arrays(blob)
        return cls(a["sizes"], a["words"], a["ranks"], a["prints"])
