"""Reachability by a cover of chains.

The vertices are dealt to disjoint paths.  Who reaches a vertex of a path reaches all after it, so
what a vertex reaches is one suffix of some of the paths, on cyclic graphs too.  Edges that don't
follow a path are exits; a search goes from suffixes to the exits in them, and its cost is that of
the exits, not of the vertices reached.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain as in_turn

import numpy as np

#: Cells of a search's state, and exits that it may follow in one step, at most (for one source both may be as many as paths and exits).
CELLS = 1 << 23


def levels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each vertex of 0..n-1 the most edges on a path that ends in it; -1 on and after cycles."""
    level, waiting = np.zeros(n, np.int64), np.bincount(b, minlength=n)
    order = np.argsort(a, kind="stable")
    first, to = np.searchsorted(a[order], np.arange(n + 1)), b[order]
    front, depth, done = np.flatnonzero(waiting == 0), 0, np.zeros(n, bool)
    while len(front):
        level[front], done[front] = depth, True
        hit = to[spread(first[front], first[front + 1])]
        np.subtract.at(waiting, hit, 1)
        front, depth = np.unique(hit[waiting[hit] == 0]), depth + 1
    return np.where(done, level, -1)


def spread(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges lo..hi-1, in turn."""
    sizes = hi - lo
    return np.repeat(lo - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def cover(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): the vertices path by path, and where each path begins; a, b are the distinct edges.

    A vertex goes on to the callee with the longest path onward, and takes the caller with the
    longest path so far, so few exits lie on a long way.
    """
    a, b = a[a != b], b[a != b]
    after, before = (np.where(x < 0, n, x) for x in (levels(n, b, a), levels(n, a, b)))
    pick = np.lexsort((-after[b], a))
    a, b = a[pick], b[pick]
    own = np.append(True, a[1:] != a[:-1])[: len(a)]
    a, b = a[own], b[own]
    pick = np.lexsort((-before[a], b))
    a, b = a[pick], b[pick]
    own = np.append(True, b[1:] != b[:-1])[: len(b)]
    follow = np.full(n, -1)
    follow[a[own]] = b[own]
    head = np.ones(n, bool)
    head[b[own]] = False
    follow, seen, order, starts = follow.tolist(), bytearray(n), [], []
    for v in in_turn(np.flatnonzero(head).tolist(), range(n)):  # paths, then cycles, cut open anywhere
        if not seen[v]:
            starts.append(len(order))
        while v >= 0 and not seen[v]:
            seen[v] = 1
            order.append(v)
            v = follow[v]
    return np.array(order, np.int64), np.array(starts, np.int64)


class Search:
    """Edges x -> y between places in the order of a cover whose paths begin at starts."""

    def __init__(self, n: int, starts: np.ndarray, x: np.ndarray, y: np.ndarray):
        self.stop = np.append(starts[1:], n)
        self.chain = np.repeat(np.arange(len(starts)), self.stop - starts)
        exits = (y != x + 1) | (self.chain[x] != self.chain[y])
        order = np.argsort(x[exits], kind="stable")
        self.first, self.to = np.searchsorted(x[exits][order], np.arange(n + 1)), y[exits][order]
        self.goes_on = np.zeros(n, bool)
        self.goes_on[x[~exits]] = True
        self.width = max(1, min(1024, CELLS // max(len(starts), len(self.to), 1)))
        self.low = np.full(self.width * len(starts), n)
        self.n = n

    def reached(self, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place, lo, hi): each of the places reaches lo..hi-1, by one edge or more."""
        for at in range(0, len(places), self.width):
            yield self._some(places[at : at + self.width])

    def _some(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        chains, touched = len(self.stop), [np.zeros(0, np.int64)]
        on = np.flatnonzero(self.goes_on[places])
        who = np.repeat(np.arange(len(places)), self.first[places + 1] - self.first[places])
        who, to = np.append(who, on), np.append(self.to[spread(self.first[places], self.first[places + 1])], places[on] + 1)
        while len(to):
            key = who * chains + self.chain[to]
            order = np.lexsort((to, key))
            key, to = key[order], to[order]
            least = np.append(True, key[1:] != key[:-1])
            key, to = key[least], to[least]
            until = np.minimum(self.low[key], self.stop[key % chains])
            key, to, until = (c[to < until] for c in (key, to, until))
            self.low[key] = to
            touched.append(key)
            who = np.repeat(key // chains, self.first[until] - self.first[to])
            to = self.to[spread(self.first[to], self.first[until])]
        key = np.unique(np.concatenate(touched))
        lo = self.low[key]
        self.low[key] = self.n
        return places[key // chains], lo, self.stop[key % chains]
