"""Sorted tables over many tasks: rows dealt by ranges of their order, places counted across the ranges.

A window function needs all rows of its key in one task. These helpers give places, counts and values
carried along a key's order while each task holds one range of it, so a key of any size is split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed

#: monotonically_increasing_id() keeps the row's number within its task in so many low bits.
PLACE_BITS = 33


def ranged(df: DataFrame, *by: Column | str) -> DataFrame:
    """df sorted over its partitions and materialised, with _at: the rows' numbers in that order, and _part, their partition.

    The order is total up to rows that are equal in all of by. The range boundaries come from a
    sample that Spark takes in a pass of its own, so df should be cheap to compute twice.
    """
    rows = checkpointed(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    return rows.withColumn("_part", F.shiftright("_at", PLACE_BITS))


def met(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on the named columns, NULL being equal to NULL; they stay as left has them."""
    other = right.select(*[F.col(n).alias(f"_of_{n}") for n in names], *[c for c in right.columns if c not in names])
    return left.join(other, reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_of_{n}")) for n in names]), how).drop(*[f"_of_{n}" for n in names])


def parts_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, _part, _first, _before, _total) of a ranged table: for each key and partition the number of its first row there, its rows in earlier partitions, and in all.

    A key has a row per partition it reaches into, so the window here is short whatever the key's size.
    """
    counts = rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select(*keys, "_part", "_first", before.alias("_before"), F.sum("_rows").over(whole).alias("_total"))


def numbered(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """df with _n, each row's place within its key in the given order from 1, and _total, the key's rows."""
    rows = ranged(df, *keys, *order)
    both = met(rows, parts_of(rows, keys), [*keys, "_part"])
    return both.select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("_n"), "_total")


def carried(df: DataFrame, keys: list[str], order: list[Column | str], value: str) -> DataFrame:
    """df with _last: the latest value of the column that is not NULL, up to and with the row, within its key.

    Inside a partition a window finds it; from partition to partition each key's last value is carried.
    """
    rows = ranged(df, *keys, *order)
    held = F.col(value).isNotNull()
    ends = rows.where(held).groupBy(*keys, "_part").agg(F.max_by(value, "_at").alias("_end"))
    parts = rows.select(*keys, "_part").distinct()
    known = met(parts, ends, [*keys, "_part"], "left")
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = known.withColumn("_carry", F.last("_end", ignorenulls=True).over(earlier)).drop("_end")
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    both = met(rows.withColumn("_own", inside), carry, [*keys, "_part"])
    return both.select(*df.columns, F.coalesce("_own", "_carry").alias("_last"))
