"""Hashes of words and runs of words, and a numpy hash index from 64-bit keys to their positions."""
from __future__ import annotations

import numpy as np
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hashes of words by word, emptied once it holds a million."""

    def __missing__(self, w):
        if len(self) > 1_000_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) | 1
        return h


_words = _Words()


def hash_words(words: list[str]) -> np.ndarray:
    """Hash of each word, in order."""
    return np.array([_words[w] for w in words], dtype=np.uint64)


def word_runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes."""
    n = len(words) - k + 1
    if n <= 0 or not k:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(n, np.uint64(k))
    with np.errstate(over="ignore"):
        for i in range(k):
            h = (h ^ words[i : i + n]) * _MIX
            h ^= h >> np.uint64(29)
    return h


class HashIndex:
    """Positions of distinct keys, found by open addressing; about 3 slots a key."""

    def __init__(self, keys: np.ndarray):
        keys = keys.astype(np.uint64)
        self.bits = max(6, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        size = 1 << self.bits
        self.keys, self.at = np.zeros(size, dtype=np.uint64), np.full(size, -1, dtype=np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            want = left[self.at[slot[left]] == -1]
            slots, first = np.unique(slot[want], return_index=True)
            self.keys[slots], self.at[slots] = keys[want[first]], want[first]
            left = left[self.at[slot[left]] != left]
            slot[left] = (slot[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where it is unknown."""
        keys = keys.astype(np.uint64, copy=False)
        slot = self._slot(keys)
        at = self.at[slot]
        same = self.keys[slot] == keys
        out = np.where(same, at, np.int32(-1))
        todo = np.flatnonzero(~same & (at != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            at = self.at[slot[todo]]
            same = (self.keys[slot[todo]] == keys[todo]) & (at != -1)
            out[todo[same]] = at[same]
            todo = todo[~same & (at != -1)]
        return out
