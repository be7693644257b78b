"""Recursive graph bisection: an order in which documents that share terms stand together.

Every bucket of documents is cut in halves, and pairs of documents, one of each half, change places
while that lowers the estimated bits of the gaps between a term's documents, d * log2(n / (d + 1))
for d of n documents. The halves are then buckets. All buckets of a level are worked on at once.
"""

from __future__ import annotations

import numpy as np

ROUNDS = 6


def bits(d: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Estimated bits of the gaps of a term in d of n documents."""
    return d * np.log2(n / (d + 1))


def spans(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[i], begins[i] + 1, ... of sizes[i] numbers each, one span after another."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def bisected(doc: np.ndarray, term: np.ndarray, count: int, smallest: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """An order of documents 0 .. count-1 that hold the terms (doc[i], term[i]), and the cuts of its buckets of at most ``smallest``.

    Each document counts once in each term; terms are small numbers.
    """
    order, cuts = np.arange(count), np.array([0, count])
    width = int(term.max()) + 1 if len(term) else 1
    bucket = np.zeros(count, np.int64)
    while count and np.diff(cuts).max() > smallest:
        begins, ends = cuts[:-1], cuts[1:]
        middles = (begins + ends + 1) // 2
        bucket[order] = np.repeat(np.arange(len(begins)), np.diff(cuts))
        right = np.zeros(count, bool)
        right[order[spans(middles, ends - middles)]] = True
        keys, entry = np.unique(bucket[doc] * width + term, return_inverse=True)
        total = np.bincount(entry, minlength=len(keys))
        shared = total > 1  # a term with one document in a bucket has none to be near, here and below
        keep = shared[entry]
        doc, term, entry = doc[keep], term[keep], (np.cumsum(shared) - 1).astype(np.int32)[entry[keep]]
        total, of = total[shared], keys[shared] // width
        n_left, n_right = (middles - begins)[of], np.maximum(1, ends - middles)[of]
        pairs = ends - middles
        left_at, right_at = spans(begins, pairs), spans(middles, pairs)
        for _ in range(rounds):
            in_right = np.bincount(entry, weights=right[doc], minlength=len(total))
            in_left = total - in_right
            now = bits(in_left, n_left) + bits(in_right, n_right)
            to_right = now - bits(np.maximum(0, in_left - 1), n_left) - bits(in_right + 1, n_right)
            to_left = now - bits(in_left + 1, n_left) - bits(np.maximum(0, in_right - 1), n_right)
            gain = np.bincount(doc, weights=np.where(right[doc], to_left[entry], to_right[entry]), minlength=count)
            order = np.lexsort((-gain, right, bucket))
            one, other = order[left_at], order[right_at]
            swap = gain[one] + gain[other] > 1e-9
            if not swap.any():
                break
            right[one[swap]], right[other[swap]] = True, False
        order = np.lexsort((np.arange(count), right, bucket))
        cuts = np.unique(np.concatenate([cuts, middles]))
    return order, cuts
