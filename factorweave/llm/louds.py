"""Level-order tries as LOUDS bitvectors.

A node's children are written as so many ones and a zero, nodes in level order, before them a node
above all roots. The j-th one is the j-th node below it, and the zeros in front of a one count the
nodes before its parent, so parents, degrees and levels all follow from the bits.
"""

from __future__ import annotations

import numpy as np


class Louds:
    """The shape of a forest. Nodes are numbered in level order from 0; -1 is the node above the roots."""

    def __init__(self, degrees: np.ndarray):
        """degrees: the number of roots, then each node's number of children in level order."""
        ends = np.cumsum(degrees + 1)
        raw = np.ones(int(ends[-1]), np.uint8)
        raw[ends - 1] = 0
        self.length, self.bits = len(raw), np.packbits(raw)

    def raw(self) -> np.ndarray:
        return np.unpackbits(self.bits, count=self.length)

    def parents(self) -> np.ndarray:
        """Each node's parent: the zeros before its one, less the node above."""
        ones = np.flatnonzero(self.raw())
        return ones - np.arange(len(ones)) - 1

    def degrees(self) -> np.ndarray:
        """Each node's number of children."""
        zeros = np.flatnonzero(self.raw() == 0)
        return np.diff(zeros) - 1

    def levels(self) -> list[tuple[int, int]]:
        """First and last (exclusive) node of each level."""
        ends = np.cumsum(self.degrees())
        roots = int(self.length - len(ends) - 1 - (ends[-1] if len(ends) else 0))
        out, begin, end = [], 0, roots
        while begin < end:
            out.append((begin, end))
            begin, end = end, roots + int(ends[end - 1])
        return out

    def rolled_up(self, values: np.ndarray) -> np.ndarray:
        """Each node's sum of values over its subtree, by levels in reverse."""
        total, parents = values.copy(), self.parents()
        for begin, end in self.levels()[:0:-1]:
            np.add.at(total, parents[begin:end], total[begin:end])
        return total
