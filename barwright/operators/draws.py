"""Drawing in turn from weights that change with every draw."""

from __future__ import annotations

import hashlib

import numpy as np


def uniform(*counter) -> float:
    """A number in [0, 1) from a counter, the same wherever and in whatever order it is asked for."""
    return int(hashlib.md5(":".join(map(str, counter)).encode()).hexdigest()[:13], 16) / 2.0 ** 52


class SumTree:
    """Weights in a binary tree of sums: drawing walks down one path, changes walk up theirs."""

    def __init__(self, weights: np.ndarray):
        self.size = 1 << max(1, int(len(weights) - 1).bit_length())
        self.sums = np.zeros(2 * self.size)
        self.sums[self.size:self.size + len(weights)] = weights
        for node in range(self.size - 1, 0, -1):
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    @property
    def total(self) -> float:
        return float(self.sums[1])

    def add(self, at: np.ndarray, change: np.ndarray) -> None:
        """Change distinct weights."""
        self.sums[self.size + at] = np.maximum(self.sums[self.size + at] + change, 0.0)
        nodes = np.unique((self.size + at) // 2)
        while len(nodes) and nodes[0]:
            self.sums[nodes] = self.sums[2 * nodes] + self.sums[2 * nodes + 1]
            nodes = np.unique(nodes // 2)

    def find(self, target: float) -> int:
        """The first weight whose running total exceeds ``target``."""
        node = 1
        while node < self.size:
            node *= 2
            if target >= self.sums[node] and self.sums[node + 1] > 0.0:
                target -= self.sums[node]
                node += 1
        return node - self.size


class Ranges:
    """Half-open ranges by length class and start, to find those that overlap another without a look at all."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, self.high = low, high
        size = np.frexp(np.maximum(high - low, 1).astype(float))[1]  # lengths below 2 ** size
        self.classes = []
        for s in np.unique(size):
            members = np.flatnonzero(size == s)
            members = members[np.argsort(low[members], kind="stable")]
            self.classes.append((1 << int(s), members, low[members]))

    def overlapping(self, low: int, high: int) -> np.ndarray:
        found = [members[np.searchsorted(starts, low - longest, side="right"):np.searchsorted(starts, high)] for longest, members, starts in self.classes]
        near = np.concatenate(found)
        return near[self.high[near] > low]


def sequential_draws(low: np.ndarray, high: np.ndarray, draws: int, *counter) -> list[int]:
    """Positions of ranges drawn in turn, each with probability proportional to its mean of 1 / (1 + draws that cover the
    step) over its steps.  A draw costs the logarithm of the number of ranges and those that overlap the drawn one.
    Ranges without steps are never drawn."""
    length = np.maximum(high - low, 1)
    weights, ranges = SumTree((high > low).astype(float)), Ranges(low, high)
    taken = np.zeros(int(high.max(initial=0)))
    picks: list[int] = []
    while len(picks) < draws and weights.total > 0.0:
        at = weights.find(uniform(*counter, len(picks)) * weights.total)
        a, z = int(low[at]), int(high[at])
        before = taken[a:z]
        lost = np.concatenate([[0.0], np.cumsum(1.0 / (before + 2.0) - 1.0 / (before + 1.0))])
        taken[a:z] += 1.0
        near = ranges.overlapping(a, z)
        near = near[high[near] > low[near]]
        weights.add(near, (lost[np.minimum(high[near], z) - a] - lost[np.maximum(low[near], a) - a]) / length[near])
        picks.append(at)
    return picks
