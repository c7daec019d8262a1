"""Cuckoo filters over 128-bit keys: four slots a bucket, 16-bit fingerprints."""

from __future__ import annotations

import numpy as np

SLOTS = 4
KICKS = 500
LOAD = 0.85


class CuckooFilter:
    """Approximate membership with deletion.

    A key that was added and not removed is always found; another one is found
    with a probability of about ``8 / 2**16``.  ``add`` returns False when the
    filter is too full; the caller then builds a larger one from its exact table.
    """

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.table = np.zeros((buckets, SLOTS), dtype=np.uint16) if table is None else table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        need = max(1, int(keys / (SLOTS * LOAD)) + 1)
        return cls(1 << (need - 1).bit_length())

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray) -> CuckooFilter:
        """A filter with all these distinct keys, doubled until they fit."""
        made = cls.sized(len(h1))
        while not made.add_all(h1, h2):
            made = cls(2 * len(made.table))
        return made

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        table = np.frombuffer(blob, dtype="<u2").astype(np.uint16).reshape(-1, SLOTS)
        return cls(len(table), table)

    def _places(self, h1: np.ndarray, h2: np.ndarray):
        mask = np.uint64(len(self.table) - 1)
        mark = (h2.view(np.uint64) >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        one = (h1.view(np.uint64) & mask).astype(np.int64)
        return mark, one, one ^ self._hop(mark.astype(np.uint64), mask)

    @staticmethod
    def _hop(mark, mask):
        return ((mark * np.uint64(0x5BD1E995) ^ (mark << np.uint64(7))) & mask).astype(np.int64)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(h1, h2)
        hit = (self.table[one] == mark[:, None]).any(axis=1)
        return hit | (self.table[two] == mark[:, None]).any(axis=1)

    def add_all(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        if len(h1) > SLOTS * len(self.table):
            return False
        marks, ones, twos = self._places(h1, h2)
        hops = self._hop(np.arange(1 << 16, dtype=np.uint64), np.uint64(len(self.table) - 1))
        return all(
            self._add(int(m), int(a), int(b), hops)
            for m, a, b in zip(marks, ones, twos, strict=True)
        )

    def _add(self, mark: int, one: int, two: int, hops: np.ndarray) -> bool:
        table = self.table
        for at in (one, two):
            free = np.flatnonzero(table[at] == 0)
            if len(free):
                table[at, free[0]] = mark
                return True
        at = two
        trail = []
        for kick in range(KICKS):
            slot = kick % SLOTS
            trail.append((at, slot, int(table[at, slot])))
            mark, table[at, slot] = int(table[at, slot]), mark
            at ^= int(hops[mark])
            free = np.flatnonzero(table[at] == 0)
            if len(free):
                table[at, free[0]] = mark
                return True
        for at, slot, old in reversed(trail):  # leave the filter as it was
            table[at, slot] = old
        return False

    def remove_all(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Take out keys that were added."""
        marks, ones, twos = self._places(h1, h2)
        for mark, one, two in zip(marks, ones, twos, strict=True):
            for at in (one, two):
                held = np.flatnonzero(self.table[at] == mark)
                if len(held):
                    self.table[at, held[0]] = 0
                    break
