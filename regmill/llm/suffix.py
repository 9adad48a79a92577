"""Suffix arrays of many short sequences at once, by prefix doubling in numpy."""

from __future__ import annotations

import numpy as np


def _starts(sorted_keys: np.ndarray) -> np.ndarray:
    """For each place, the first place that holds the same key."""
    new = np.empty(len(sorted_keys), bool)
    new[:1] = True
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=new[1:])
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


class Suffixes:
    """Sequences lie end to end in `ids`; `seq` tells each position's sequence (ascending).

    `levels[k]` ranks each suffix by its first 2**k items among all suffixes; suffixes of different
    sequences never share a rank. Suffixes that stand alone keep their rank and leave the later rounds.
    """

    def __init__(self, ids: np.ndarray, seq: np.ndarray):
        n = self.n = len(ids)
        self.end = np.searchsorted(seq, seq, "right")
        key = seq.astype(np.int64) * (int(ids.max(initial=0)) + 1) + ids
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        rank[order] = start = _starts(key[order])
        self.levels, self.live = [rank], [self._repeated(order, start)]
        step = 1
        while len(live := self.live[-1]):
            after = live + step
            key = rank[live] * (n + 1) + np.where(after < self.end[live], rank[np.minimum(after, n - 1)] + 1, 0)
            order = np.argsort(key)
            place, old = live[order], rank[live[order]]
            start = _starts(key[order])
            rank = rank.copy()
            rank[place] = old + start - _starts(old)
            self.levels.append(rank)
            self.live.append(self._repeated(place, start))
            step *= 2

    @staticmethod
    def _repeated(place: np.ndarray, start: np.ndarray) -> np.ndarray:
        size = np.bincount(start, minlength=len(start))
        return np.sort(place[size[start] > 1])

    def grams(self, at: np.ndarray) -> np.ndarray:
        """Of `at`, the positions whose three items stand twice or more in their sequence."""
        if len(self.levels) < 2:
            return at[:0]
        at = at[at + 2 < self.end[at]]
        key = self.levels[1][at] * (self.n + 1) + self.levels[0][at + 2]
        order = np.argsort(key)
        return self._repeated(at[order], _starts(key[order]))

    def longest(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions in suffix order that share `least` or more items with a neighbour, and how many they share at most."""
        k = min(int(least).bit_length() - 1, len(self.live) - 1)
        at = self.live[k]
        at = at[np.argsort(self.levels[-1][at])]
        a, b = at[:-1], at[1:]
        common = np.zeros(len(a), np.int64)
        for power in range(len(self.levels) - 1, -1, -1):
            rank, x, y = self.levels[power], a + common, b + common
            inside = (x < self.end[a]) & (y < self.end[b])
            same = inside & (rank[np.minimum(x, self.n - 1)] == rank[np.minimum(y, self.n - 1)])
            common += same * (1 << power)
        most = np.zeros(len(at), np.int64)
        most[:-1] = common
        most[1:] = np.maximum(most[1:], common)
        keep = most >= least
        return at[keep], most[keep]

    def covered(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Marks of the positions in the union of the spans."""
        edge = np.zeros(self.n + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
        return np.cumsum(edge[:-1]) > 0
