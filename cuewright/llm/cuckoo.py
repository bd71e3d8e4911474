"""A cuckoo filter of 64-bit keys: no false negatives, insertion and deletion."""

from __future__ import annotations

import numpy as np

from .text_arrays import mix

SLOTS = 4
MAX_KICKS = 500


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a bucket's other choice is its number xor a hash of the fingerprint."""

    def __init__(self, capacity: int) -> None:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(capacity, 1) / (SLOTS * 0.84)))) if capacity else 2)
        self.table = np.zeros((buckets, SLOTS), np.uint16)
        self.mask = buckets - 1

    def _fingerprints(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mixed = mix(keys.view(np.uint64) if keys.dtype == np.int64 else keys.astype(np.uint64))
        mark = (mixed >> np.uint64(48)).astype(np.int64) % 65535 + 1
        one = (mixed & np.uint64(self.mask)).astype(np.int64)
        return mark, one, one ^ self._jump(mark)

    def _jump(self, mark: np.ndarray) -> np.ndarray:
        return (mix(mark.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._fingerprints(keys)
        want = mark.astype(np.uint16)[:, None]
        return (self.table[one] == want).any(1) | (self.table[two] == want).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """Adds keys one by one; False if the table is too full (then build a larger one)."""
        mark, one, two = (x.tolist() for x in self._fingerprints(keys))
        table = self.table
        for m, a, b in zip(mark, one, two, strict=True):
            at = a
            for kick in range(MAX_KICKS):
                free = np.flatnonzero(table[at] == 0)
                if len(free):
                    table[at, free[0]] = m
                    break
                if kick == 0 and at != b:
                    at = b
                    continue
                slot = kick % SLOTS
                m, table[at, slot] = int(table[at, slot]), m
                at = int(at ^ self._jump(np.array([m]))[0])
            else:
                return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Takes out keys that were inserted before."""
        mark, one, two = (x.tolist() for x in self._fingerprints(keys))
        for m, a, b in zip(mark, one, two, strict=True):
            for at in (a, b):
                held = np.flatnonzero(self.table[at] == m)
                if len(held):
                    self.table[at, held[0]] = 0
                    break

    @classmethod
    def of(cls, keys: np.ndarray, room: int = 1) -> CuckooFilter:
        """A filter of the keys, with space for ``room`` times as many."""
        capacity = room * len(keys)
        while True:
            made = cls(capacity)
            if made.insert(keys):
                return made
            capacity = max(2 * capacity, 8)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, writable: bool = False) -> CuckooFilter:
        made = cls(0)
        table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS)
        made.table = table.copy() if writable else table
        made.mask = len(made.table) - 1
        return made
