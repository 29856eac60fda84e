"""A minimal perfect hash over 64-bit keys, built and probed with numpy.

Keys are dealt into the bits of a first level; a bit that exactly one key asks for is
that key's place, the others go on to a smaller next level. The place of a key is the
number of set bits before its own. Keys still together after `LEVELS` levels (equal
64-bit hashes) go to a short sorted rest.
"""

from __future__ import annotations

import struct

import numpy as np

LEVELS = 48
_WORD = np.uint64(64)


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """One round of a 64-bit finalizer, different for each seed."""
    x = keys ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    def __init__(self, sizes: list[int], words: np.ndarray, rest: np.ndarray):
        self.sizes, self.words, self.rest = sizes, words, rest
        counts = np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.placed = int(self.before[-1])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, parts = np.asarray(keys, np.uint64), [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = (2 * len(left) + 63) // 64 * 64
            at = mix(left, level) % np.uint64(size)
            asked = np.bincount(at.astype(np.int64), minlength=size)
            alone = asked == 1
            parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone[at.astype(np.int64)]]
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.sort(left))

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place; -1 or any place for a key that was not built in."""
        keys = np.asarray(keys, np.uint64)
        out = np.full(len(keys), -1, np.int64)
        open_, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = mix(keys[open_], level) % np.uint64(size) + np.uint64(base)
            word, bit = (at // _WORD).astype(np.int64), at % _WORD
            found = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[found]] = (self.before[word] + np.bitwise_count(below).astype(np.int64))[found]
            open_, base = open_[~found], base + size
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            found = self.rest[at] == keys[open_]
            out[open_[found]] = self.placed + at[found]
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack(f"<qq{len(self.sizes)}q", len(self.sizes), len(self.words), *self.sizes)
        return head + self.words.tobytes() + self.rest.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> PerfectHash:
        n, words = struct.unpack_from("<qq", blob)
        sizes, at = list(struct.unpack_from(f"<{n}q", blob, 16)), 16 + 8 * n
        return cls(sizes, np.frombuffer(blob, np.uint64, words, at), np.frombuffer(blob, np.uint64, -1, at + 8 * words))
