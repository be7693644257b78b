"""The one vectorised helper: many small linear systems at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What may be left of a column's squared length, of 1, once the columns before it are taken out; below that they are collinear.
LEFT = 1e-12


def pivoted_cholesky(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of many symmetric positive systems a x = b, and which of them have full rank.

    a has unit diagonals. Each step takes the column of which most is left and clears it from the others.
    """
    count, k = b.shape
    a, b, each = a.copy(), b.copy(), np.arange(count)
    order, fine = np.tile(np.arange(k), (count, 1)), np.ones(count, bool)
    low = np.zeros((count, k, k))
    for s in range(k):
        left = np.einsum("nii->ni", a)[:, s:]
        p = s + left.argmax(axis=1)
        for m in (order, b):
            m[each, s], m[each, p] = m[each, p].copy(), m[each, s].copy()
        for m in (a, low):
            m[each, s], m[each, p] = m[each, p].copy(), m[each, s].copy()
        a[each, :, s], a[each, :, p] = a[each, :, p].copy(), a[each, :, s].copy()
        top = a[:, s, s]
        fine &= top > LEFT
        low[:, s:, s] = a[:, s:, s] / np.sqrt(np.where(top > LEFT, top, 1.0))[:, None]
        a[:, s:, s:] -= low[:, s:, s][:, :, None] * low[:, s:, s][:, None, :]
    low[~fine] = np.eye(k)
    y = np.linalg.solve(low, b[:, :, None])
    x = np.linalg.solve(low.transpose(0, 2, 1), y)[:, :, 0]
    out = np.empty_like(x)
    np.put_along_axis(out, order, x, axis=1)
    return out, fine


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def solve_gram(gram: pd.Series, right: pd.Series) -> pd.Series:
    """Solutions of the systems (Gram matrix by rows, right side); NULL for singular or incomplete ones."""
    out = pd.Series([None] * len(gram), dtype=object)
    whole = [g is not None and r is not None and np.isfinite(np.asarray(g, float)).all() and np.isfinite(np.asarray(r, float)).all() for g, r in zip(gram, right)]
    at = np.flatnonzero(whole)
    if not len(at):
        return out
    b = np.stack([np.asarray(right.iloc[i], float) for i in at])
    k = b.shape[1]
    a = np.stack([np.asarray(gram.iloc[i], float) for i in at]).reshape(-1, k, k)
    lengths = np.sqrt(np.maximum(np.einsum("nii->ni", a), 0))
    scale = np.where(lengths > 0, lengths, 1.0)
    x, fine = pivoted_cholesky(a / scale[:, :, None] / scale[:, None, :], b / scale)
    for i, row, ok in zip(at, x / scale, fine & (lengths > 0).all(axis=1)):
        if ok:
            out.iloc[i] = row.tolist()
    return out
