"""A cuckoo filter over 64-bit keys, built and probed with numpy arrays.

Buckets of four 16-bit fingerprints; a key may be in either of two buckets whose
numbers differ by a hash of the fingerprint (partial-key cuckoo hashing). Deleting
takes one copy of a fingerprint out of one of the two. A filter that fills up is
rebuilt with twice the buckets by its owner, who has the exact keys.
"""

from __future__ import annotations

import numpy as np

SLOTS = 4
_KICKS = 500


class Full(Exception):
    """There is no room for a key; rebuild with more buckets."""


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class CuckooFilter:
    def __init__(self, buckets: int, table: np.ndarray | None = None) -> None:
        self.buckets = 1 << max(1, int(buckets) - 1).bit_length()
        self.table = np.zeros((self.buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(max(2, int(keys / (SLOTS * 0.8)) + 1))

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints (never 0) and both buckets."""
        h = _mix(keys)
        prints = (h >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        one = (h & np.uint64(self.buckets - 1)).astype(np.int64)
        return prints, one, self.other(one, prints)

    def other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ (_mix(prints) & np.uint64(self.buckets - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, bool)
        p, a, b = self.places(keys)
        return ((self.table[a] == p[:, None]) | (self.table[b] == p[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> None:
        """Adds every key once more; raises Full and leaves the table in a state to be rebuilt."""
        p, a, b = self.places(keys)
        # Whoever finds a free slot takes it, all keys at once: first bucket, then second.
        p, a, b = self._settle(p, a, b, a)
        p, a, b = self._settle(p, a, b, b)
        rng = np.random.default_rng(0)
        for fp, at in zip(p, a, strict=True):
            self._kick(fp, int(at), rng)

    def _settle(self, p, a, b, bucket):
        if not len(p):
            return p, a, b
        order = np.argsort(bucket, kind="stable")
        sorted_ = bucket[order]
        first = np.r_[0, np.flatnonzero(np.diff(sorted_)) + 1]
        turn = np.arange(len(sorted_)) - np.repeat(first, np.diff(np.r_[first, len(sorted_)]))
        free = self.table[sorted_] == 0
        place = np.where(free, np.cumsum(free, axis=1) - 1, -1) == turn[:, None]
        got = place.any(axis=1)
        self.table[sorted_[got], place[got].argmax(axis=1)] = p[order][got]
        rest = np.sort(order[~got])
        return p[rest], a[rest], b[rest]

    def _kick(self, fp, at: int, rng) -> None:
        for _ in range(_KICKS):
            for bucket in (at, int(self.other(np.array([at]), np.array([fp], np.uint16))[0])):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = fp
                    return
            slot = int(rng.integers(SLOTS))
            fp, self.table[bucket, slot] = self.table[bucket, slot], fp
            at = int(self.other(np.array([bucket]), np.array([fp], np.uint16))[0])
        raise Full

    def delete(self, keys: np.ndarray) -> None:
        """Takes every key out once; each must have been inserted."""
        for fp, a, b in zip(*self.places(keys), strict=True):
            for bucket in (a, b):
                at = np.flatnonzero(self.table[bucket] == fp)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(table), table)


def built(keys: np.ndarray) -> CuckooFilter:
    """A filter with all keys, as large as it takes."""
    f = CuckooFilter.sized(len(keys))
    while True:
        try:
            f.insert(keys)
            return f
        except Full:
            f = CuckooFilter(2 * f.buckets)
