"""Vantage-point trees over 64-bit fingerprints under the Hamming distance.

A node has a vantage point v and a distance mu: points at most mu away from v are inside, the others
outside. Two points within ``radius`` of each other have distances from v that differ by at most
radius (the triangle bound), so a search has to enter a branch only if its border is that near.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Points tried as vantage point of a node.
TRIED = 12


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def best_split(points: np.ndarray, radius: int) -> tuple[np.uint64, int] | None:
    """Vantage point and distance with the fewest points near the border for the balance they give; None if no point splits them."""
    best, found = None, None
    for v in points[np.unique(np.linspace(0, len(points) - 1, TRIED).astype(int))]:
        counts = np.bincount(distance(points, v), minlength=65)
        inside = np.cumsum(counts)
        for mu in np.flatnonzero((inside > 0) & (inside < len(points))):
            share = inside[mu] / len(points)
            near = counts[max(0, mu - radius + 1) : mu + radius + 1].sum() / len(points)
            worth = (1 - near) * min(share, 1 - share) + min(share, 1 - share) / 8
            if best is None or worth > best:
                best, found = worth, (v, int(mu))
    return found


class VantageTree:
    """A tree fitted to points, which may be a sample of those it is asked about.

    Nodes are numbered from the root; children are node numbers, or ~number of a leaf.
    """

    def __init__(self, points: np.ndarray, leaf: int, radius: int = 2):
        self.radius = radius
        self.nodes: list[list] = []
        self.leaves: list[np.ndarray] = []
        self.root = 0
        open_ = [(np.arange(len(points)), None, 0)]
        while open_:
            at, parent, side = open_.pop()
            split = best_split(points[at], radius) if len(at) > leaf else None
            if split:
                number = len(self.nodes)
                self.nodes.append([split[0], split[1], 0, 0])
                near = distance(points[at], split[0]) <= split[1]
                open_ += [(at[near], number, 2), (at[~near], number, 3)]
            else:
                number = ~len(self.leaves)
                self.leaves.append(at)
            if parent is None:
                self.root = number
            else:
                self.nodes[parent][side] = number

    def reached(self, queries: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, places of the queries that have to search it)."""
        open_ = [(self.root, np.arange(len(queries)))]
        while open_:
            number, at = open_.pop()
            if not len(at):
                continue
            if number < 0:
                yield ~number, at
                continue
            v, mu, inside, outside = self.nodes[number]
            d = distance(queries[at], v)
            open_ += [(inside, at[d <= mu + self.radius]), (outside, at[d > mu - self.radius])]

    def routed(self, points: np.ndarray) -> Iterator[tuple[int, bool, np.ndarray]]:
        """(leaf, whether as visitors, places of points): each point once at home, and as a visitor where a near point may be at home.

        Of two near points that a border parts, the outer one visits the inner one's side, which finds the pair.
        """
        open_ = [(self.root, False, np.arange(len(points)))]
        while open_:
            number, visiting, at = open_.pop()
            if not len(at):
                continue
            if number < 0:
                yield ~number, visiting, at
                continue
            v, mu, inside, outside = self.nodes[number]
            d = distance(points[at], v)
            if visiting:
                open_ += [(inside, True, at[d <= mu + self.radius]), (outside, True, at[d > mu - self.radius])]
            else:
                open_ += [(inside, False, at[d <= mu]), (outside, False, at[d > mu]), (inside, True, at[(d > mu) & (d <= mu + self.radius)])]

    def pairs(self, points: np.ndarray, queries: np.ndarray, block: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of queries, places of points) within the radius; points are those the tree was fitted to."""
        for leaf, at in self.reached(queries):
            own = self.leaves[leaf]
            step = max(1, block // max(1, len(own)))
            for first in range(0, len(at), step):
                some = at[first : first + step]
                q, p = np.nonzero(distance(queries[some][:, None], points[own][None, :]) <= self.radius)
                if len(q):
                    yield some[q], own[p]


def united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of a and b; label holds each point's component, the smallest place in it."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        np.minimum.at(label, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while True:
            further = label[label]
            if (further == label).all():
                break
            label[:] = further
