"""Ids of parts of text, remembered by the parts' 64-bit hashes in an open-addressing table of numpy arrays."""

from __future__ import annotations

import numpy as np

from tarnbeck.llm.text import concat_ranges


class IdTable:
    """Holds about `remember` parts; `room` empties it once there are more."""

    def __init__(self, remember: int):
        self.remember = remember
        self.clear()

    def clear(self) -> None:
        self.keys, self.codes = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)
        self.flat, self.size = np.zeros(1 << 16, np.uint32), 0
        self.start, self.count, self.used = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int32), 0

    def room(self) -> None:
        if self.used > self.remember:
            self.clear()

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The code of each hash, or -1. Hash 0 is not allowed."""
        out = np.full(len(hashes), -1, np.int64)
        mask, at = np.uint64(len(self.keys) - 1), np.arange(len(hashes))
        slot = hashes & mask
        while len(at):
            key = self.keys[slot]
            hit = key == hashes[at]
            out[at[hit]] = self.codes[slot[hit]]
            on = ~hit & (key != 0)
            at, slot = at[on], (slot[on] + np.uint64(1)) & mask
        return out

    def _place(self, hashes: np.ndarray, codes: np.ndarray) -> None:
        mask = np.uint64(len(self.keys) - 1)
        slot = hashes & mask
        while len(hashes):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.codes[slot[won]] = hashes[won], codes[won]
            lost = np.ones(len(hashes), bool)
            lost[won] = False
            hashes, codes, slot = hashes[lost], codes[lost], (slot[lost] + np.uint64(1)) & mask

    def add(self, hashes: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Distinct new hashes get the codes from `used` on; ids are those of all, one after the other. The table stays at most half full."""
        n, k = len(hashes), self.used
        while 2 * (k + n) > len(self.keys):
            old = np.flatnonzero(self.keys)
            keys, kept, size = self.keys[old], self.codes[old], 2 * len(self.keys)
            self.keys, self.codes = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._place(keys, kept)
        while k + n > len(self.start):
            self.start, self.count = np.resize(self.start, 2 * len(self.start)), np.resize(self.count, 2 * len(self.count))
        while self.size + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.size : self.size + len(ids)] = ids
        self.start[k : k + n] = self.size + np.cumsum(count) - count
        self.count[k : k + n] = count
        self.size, self.used = self.size + len(ids), k + n
        self._place(hashes, np.arange(k, k + n, dtype=np.int32))

    def ids(self, code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts in a row, and how many each text has; first[i] is the index of text i's first part, with one entry more than texts."""
        size = self.count[code].astype(np.int64)
        ends = np.zeros(len(code) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        return self.flat[concat_ranges(self.start[code], size)], np.diff(ends[first])
