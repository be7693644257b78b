"""Counts, means and centred sums of products of columns, per group or over trailing rows.

Centred sums keep the digits that raw sums of squares lose where means are large beside deviations.
They merge: two groups' sums add up, plus a term in the difference of their means. So does every
aggregate here, from task to task and from block to block of a rolling window.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def named(names: list[str]) -> list[tuple[str, str]]:
    return list(combinations_with_replacement(names, 2))


def moments(names: list[str], over: Callable[[Column], Column] = lambda c: c) -> Column:
    """A struct of n, means m_<name> and centred sums c_<i>_<j> (i <= j) over the rows on which all columns have a value."""
    whole = F.lit(True)
    for n in names:
        whole = whole & F.col(n).isNotNull()
    held = {n: F.when(whole, F.col(n)) for n in names}
    count = over(F.count(F.when(whole, 1)))
    means = [over(F.avg(held[n])).alias(f"m_{i}") for i, n in enumerate(names)]
    sums = [(over(F.covar_pop(held[a], held[b])) * count).alias(f"c_{names.index(a)}_{names.index(b)}") for a, b in named(names)]
    return F.struct(count.alias("n"), *means, *sums)


def merged(one: Column, other: Column, k: int) -> Column:
    """The moments of two sets of rows together; either may have none."""
    n, m = one["n"], other["n"]
    share = m / (n + m)
    parts = [(n + m).alias("n")]
    parts += [F.when(n == 0, other[f"m_{i}"]).when(m == 0, one[f"m_{i}"]).otherwise(one[f"m_{i}"] + (other[f"m_{i}"] - one[f"m_{i}"]) * share).alias(f"m_{i}") for i in range(k)]
    apart = [other[f"m_{i}"] - one[f"m_{i}"] for i in range(k)]
    for i in range(k):
        for j in range(i, k):
            c = f"c_{i}_{j}"
            parts.append(F.when(n == 0, other[c]).when(m == 0, one[c]).otherwise(one[c] + other[c] + apart[i] * apart[j] * n * share).alias(c))
    return F.struct(*parts)


def rolled(df: DataFrame, key: str, order: str, names: list[str], width: int) -> DataFrame:
    """df with _rolled, the moments of the last ``width`` rows of the key up to each row, and _rows, how many rows those are.

    Each key's rows are cut into blocks of width. A frame is the end of one block and the beginning of
    the next, and both grow row by row, so a row costs one merge whatever the width.
    """
    of_key = Window.partitionBy(key).orderBy(order)
    rows = df.withColumn("_at", F.row_number().over(of_key) - 1).withColumn("_block", F.floor(F.col("_at") / width))
    ahead = Window.partitionBy(key, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(key, "_block").orderBy(F.col("_at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.withColumn("_head", moments(names, lambda c: c.over(ahead))).withColumn("_tail", moments(names, lambda c: c.over(back)))
    told = both.withColumn("_before", F.lag("_tail", width - 1).over(Window.partitionBy(key).orderBy("_at")))
    alone = F.col("_before").isNull() | (F.col("_at") % width == width - 1)
    told = told.withColumn("_rolled", F.when(alone, F.col("_head")).otherwise(merged(F.col("_before"), F.col("_head"), len(names))))
    return told.withColumn("_rows", F.least(F.col("_at") + 1, F.lit(width))).drop("_at", "_block", "_head", "_tail", "_before")


def system(of: Column, k: int) -> tuple[Column, Column]:
    """Of moments of k columns and then ret: the centred Gram matrix of the k by rows, and their centred sums with ret."""
    gram = F.array(*[of[f"c_{min(i, j)}_{max(i, j)}"] for i in range(k) for j in range(k)])
    return gram, F.array(*[of[f"c_{i}_{k}"] for i in range(k)])
