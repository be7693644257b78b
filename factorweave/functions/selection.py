"""Exact quantiles by counting: passes over the values that narrow a range per key until it holds one value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed
from .ranges import met

#: Bins that a pass cuts each open range into, and passes at most; a pass that halves a range is the worst case, and doubles have 2**64 values.
BINS, PASSES = 1024, 70


def order_statistics(values: DataFrame, keys: list[str], column: str, wanted: DataFrame, bins: int = BINS) -> DataFrame:
    """Rows (keys, rank, value): the value that stands at each rank wanted (keys, rank from 1, low, high: the key's smallest and largest value).

    A pass counts the values of each open range by bins. The bin that holds the rank becomes the range,
    from its smallest to its largest value, so ranges hold a value of the column at both ends. Only
    counts per key and bin are shuffled; no values are gathered.
    """
    spark = values.sparkSession
    open_, found = checkpointed(wanted.withColumn("before", F.lit(0).cast("long"))), None
    for _ in range(PASSES):
        settled = open_.where("low = high").select(*keys, "rank", F.col("low").alias("value"))
        found = settled if found is None else found.unionByName(settled)
        open_ = open_.where("low <> high")
        if open_.isEmpty():
            return found
        ranges = open_.select(*keys, "low", "high", "before").distinct()
        inside = met(values, ranges, keys).where(F.col(column).between(F.col("low"), F.col("high")))
        share = (F.col(column) / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        binned = inside.withColumn("bin", F.least(F.floor(share * bins), F.lit(bins - 1)))
        counts = binned.groupBy(*keys, "low", "high", "before", "bin").agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("least"), F.max(column).alias("most"))
        so_far = F.sum("n").over(Window.partitionBy(*keys, "low", "high", "before").orderBy("bin"))
        upto = counts.withColumn("upto", F.col("before") + so_far)
        chosen = met(open_, upto.withColumn("from", F.col("upto") - F.col("n")), [*keys, "low", "high", "before"]).where((F.col("rank") > F.col("from")) & (F.col("rank") <= F.col("upto")))
        open_ = checkpointed(chosen.select(*keys, "rank", F.col("least").alias("low"), F.col("most").alias("high"), F.col("from").alias("before")))
    raise RuntimeError(f"ranges did not close in {PASSES} passes")


def quantiles(df: DataFrame, keys: list[str], column: str, wanted: dict[str, float]) -> DataFrame:
    """Rows (keys, one column per name in wanted): quantiles between 0 and 1 that interpolate between the two nearest values, as percentile does.

    NULL and NaN values are not counted; a key without any other value has no row.
    """
    held = df.select(*keys, F.col(column).cast("double").alias(column)).where(F.col(column).isNotNull() & ~F.isnan(column))
    sizes = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
    places = F.array(*[F.lit(float(q)) * (F.col("n") - 1) for q in wanted.values()])
    sizes = checkpointed(sizes.withColumn("places", places))
    ranks = F.array_distinct(F.flatten(F.transform("places", lambda x: F.array(F.floor(x) + 1, F.ceil(x) + 1))))
    stats = order_statistics(held, keys, column, sizes.select(*keys, "low", "high", F.explode(ranks).alias("rank")))
    by_rank = stats.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))

    def between(i: int):
        x = F.col("places")[i]
        below, above = (F.element_at("at", f(x) + 1) for f in (F.floor, F.ceil))
        return below + (above - below) * (x - F.floor(x))

    return met(sizes, by_rank, keys).select(*keys, *[between(i).alias(name) for i, name in enumerate(wanted)])
