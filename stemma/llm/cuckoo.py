"""Cuckoo filters over 128-bit keys, filled and probed in whole arrays."""

from __future__ import annotations

import numpy as np

SLOTS = 4
KICKS = 500
#: Part of the slots that is filled at most, so that kicks stay short, and the bits of a mark.
LOAD, MARKS = 0.9, 0xFFFF


class CuckooFilter:
    """16-bit fingerprints in buckets of four slots; false positives near 0.012 %.

    A key's second bucket follows from its first and its fingerprint, so entries
    move without their key and can be removed again. Only keys that were added may
    be removed.
    """

    def __init__(self, keys: int, table: np.ndarray | None = None):
        if table is None:
            buckets = 1 << max(2, int(np.ceil(np.log2(max(keys, 1) / (SLOTS * 0.85)))))
            table = np.zeros((buckets, SLOTS), np.uint16)
        self.table = table

    @staticmethod
    def from_bytes(blob: bytes) -> CuckooFilter:
        return CuckooFilter(0, np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (lo.view(np.uint64) >> np.uint64(48)).astype(np.uint16) & np.uint16(MARKS)
        mark[mark == 0] = 1
        one = (hi.view(np.uint64) & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, one, self._other(one, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        spread = (mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        return bucket ^ (spread & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _fill(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Put marks into free slots of their buckets; True where one was found."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        first = np.concatenate(([True], b[1:] != b[:-1])) if len(b) else np.empty(0, bool)
        rank = np.arange(len(b)) - np.maximum.accumulate(np.where(first, np.arange(len(b)), 0)) if len(b) else np.empty(0, np.int64)
        free = self.table[b] == 0
        slot = np.argsort(~free, axis=1, kind="stable")
        fits = rank < free.sum(axis=1)
        chosen = slot[np.arange(len(b)), np.minimum(rank, SLOTS - 1)]
        self.table[b[fits], chosen[fits]] = mark[order][fits]
        done = np.zeros(len(b), bool)
        done[order] = fits
        return done

    def add(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Add keys; returns True for those that found no place (the filter is full)."""
        room = max(0, int(LOAD * self.table.size) - np.count_nonzero(self.table))
        if len(hi) > room:
            failed = np.ones(len(hi), bool)
            if room:
                failed[:room] = self.add(hi[:room], lo[:room])
            return failed
        mark, one, two = self._places(hi, lo)
        left = np.flatnonzero(~self._fill(one, mark))
        left = left[~self._fill(two[left], mark[left])]
        failed = np.zeros(len(mark), bool)
        table, mask = self.table, len(self.table) - 1
        for i in left.tolist():
            m, at, trail = int(mark[i]), int(two[i]), []
            for kick in range(KICKS):
                row = table[at]
                empty = np.flatnonzero(row == 0)
                if len(empty):
                    row[empty[0]] = m
                    break
                slot = (m + kick) % SLOTS
                trail.append((at, slot, int(row[slot])))
                row[slot], m = m, int(row[slot])
                at ^= ((m * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 32) & mask
            else:
                for at, slot, m in reversed(trail):
                    table[at, slot] = m
                failed[i] = True
        return failed

    def has(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(hi, lo)
        return ((self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])).any(axis=1)

    def remove(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Remove one entry of each key; returns True for those that had none."""
        mark, one, two = self._places(hi, lo)
        missing = np.zeros(len(mark), bool)
        for i, (m, a, b) in enumerate(zip(mark.tolist(), one.tolist(), two.tolist())):
            for at in (a, b):
                held = np.flatnonzero(self.table[at] == m)
                if len(held):
                    self.table[at, held[0]] = 0
                    break
            else:
                missing[i] = True
        return missing


def filled(hi: np.ndarray, lo: np.ndarray, filters: list[CuckooFilter], spare: int = 0) -> list[CuckooFilter]:
    """The filters with more keys; further ones, with room for ``spare`` keys at least, are opened until all have a place."""
    for f in filters:
        if len(hi):
            full = f.add(hi, lo)
            hi, lo = hi[full], lo[full]
    made = list(filters)
    while len(hi):
        made.append(CuckooFilter(max(len(hi), spare)))
        full = made[-1].add(hi, lo)
        hi, lo = hi[full], lo[full]
    return made
