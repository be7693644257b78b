"""Operators on panels of (asset, date): prices, returns, cross-sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import carried, met, numbered
from ..functions.selection import quantiles
from ..sources.shared import checkpointed


def by_asset():
    return Window.partitionBy("asset").orderBy("date")


def resample(prices: DataFrame, freq: str = "month", how: str = "last") -> DataFrame:
    """Prices at a lower frequency: the period's last price and weight, or value / quantity ("ratio")."""
    period = F.date_trunc(freq, "date").cast("date").alias("date")
    if how == "ratio":
        return prices.groupBy("asset", period).agg((F.sum("value") / F.sum("quantity")).alias("price"), F.sum("quantity").alias("weight"))
    return prices.groupBy("asset", period).agg(F.max_by("price", prices["date"]).alias("price"), F.max_by("weight", prices["date"]).alias("weight"))


def missing_cells(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """(asset, date) pairs of the calendar without a row, by gaps between neighbouring rows; no pair that exists is made.

    Dates are numbered over ranges, and gaps before an asset's first row and behind its last are found by the numbers of the first and last date.
    """
    dates = checkpointed(numbered(calendar.select("date").where("date is not null").distinct(), [], ["date"]).select("date", F.col("_n").alias("i"), F.col("_total").alias("count")))
    there = panel.select("asset", "date").distinct().join(dates, "date").select("asset", "i", "count")
    ends = panel.select("asset").distinct().crossJoin(F.broadcast(dates.where("i = 1").select("count")))  # one row
    ends = ends.select("asset", F.explode(F.array(F.lit(0).cast("long"), F.col("count") + 1)).alias("i"))
    ahead = F.lead("i").over(Window.partitionBy("asset").orderBy("i"))
    gaps = there.select("asset", "i").unionByName(ends).withColumn("next", ahead).where("next > i + 1")
    return gaps.select("asset", F.explode(F.sequence(F.col("i") + 1, F.col("next") - 1)).alias("i")).join(dates.select("i", "date"), "i").select("asset", "date")


def returns(prices: DataFrame, kind: str = "simple", step: Column | None = None) -> DataFrame:
    """Returns from each price to the next; each asset's first row is dropped.

    A row whose own price or the one before is NULL, or that follows a price of zero, has a NULL return. step is the longest distance in days that counts as one period; over a longer gap the return is
    NULL. Without it a gap gives a return over several periods.
    """
    before = F.lag("price").over(by_asset())
    ratio = F.try_divide(F.col("price"), before)
    value = F.log(ratio) if kind == "log" else ratio - 1
    if step is not None:
        value = F.when(F.date_diff("date", F.lag("date").over(by_asset())) <= step, value)
    told = prices.withColumn("_row", F.row_number().over(by_asset())).withColumn("ret", value)
    return told.where("_row > 1").select("asset", "date", "ret")


def excess(rets: DataFrame, riskfree: DataFrame) -> DataFrame:
    """Returns less the risk-free return (date, rf) of the date; a date without one gives NULL."""
    return rets.join(riskfree, "date", "left").select("asset", "date", (F.col("ret") - F.col("rf")).alias("ret"))


def asof_attach(panel: DataFrame, slow: DataFrame, column: str) -> DataFrame:
    """panel with the last value of column in slow at or before each date, per asset; NULL before the first.

    A union in the order of asset and date, looked-up rows first on equal dates, dealt by ranges of that
    order: an asset of any size is many tasks, each of which takes over the value that the one before it
    held last. A looked-up NULL is a value.
    """
    looked = slow.select("asset", "date", F.struct(F.col(column)).alias("_held"), F.lit(0).alias("_side"))
    own = [c for c in panel.columns if c not in ("asset", "date")]
    rows = panel.select("asset", "date", F.struct(*own, F.lit(1).alias("_own")).alias("_row"), F.lit(1).alias("_side"))
    both = looked.unionByName(rows, allowMissingColumns=True)
    found = carried(both, ["asset"], ["date", "_side", F.xxhash64("_row", "_held")], "_held").where("_side = 1")
    return found.select("asset", "date", *[F.col(f"_row.{c}") for c in own], F.col(f"_last.{column}"))


def winsorize(df: DataFrame, column: str, low: float, high: float, accuracy: int | None = None) -> DataFrame:
    """column clipped to its percentiles of the date: exact ones, or approximate ones by sketches of an accuracy."""
    if accuracy is None:
        limits = quantiles(df.select("date", column), ["date"], column, {"_low": low, "_high": high})
    else:
        limits = df.groupBy("date").agg(*[F.percentile_approx(column, q, accuracy).alias(n) for n, q in (("_low", low), ("_high", high))])
    clipped = F.when(F.col(column).isNotNull(), F.greatest("_low", F.least("_high", column)))
    return met(df, limits, ["date"], "left").withColumn(column, clipped).drop("_low", "_high").select(df.columns)


def zscore(df: DataFrame, column: str) -> DataFrame:
    """column standardised by the date's mean and sample deviation; NULL if that is zero or missing.

    Means and deviations are aggregated before they meet the rows, so no task holds a cross-section.
    """
    stats = df.groupBy("date").agg(F.avg(column).alias("_mean"), F.stddev_samp(column).alias("_dev"))
    value = F.when(F.col("_dev") > 0, (F.col(column) - F.col("_mean")) / F.col("_dev"))
    return df.join(stats, "date").withColumn("z", value).drop("_mean", "_dev")


def market_factor(rets: DataFrame, weight: str | None = None) -> DataFrame:
    """The date's mean return (date, factor, value): equal-weighted, or weighted by a column."""
    if weight is None:
        value = F.avg("ret")
    else:
        held = F.col("ret").isNotNull() & F.col(weight).isNotNull()
        value = F.try_divide(F.sum(F.when(held, F.col(weight) * F.col("ret"))), F.sum(F.when(held, F.col(weight))))
    return rets.groupBy("date").agg(value.alias("value")).select("date", F.lit("mkt").alias("factor"), "value")


def sorted_portfolios(df: DataFrame, column: str, k: int) -> DataFrame:
    """(date, bucket, n, ret): each date's assets in k buckets by column, ties by asset, and their mean return.

    A row's place in its date is counted over ranges of (date, column, asset), so a cross-section of any
    size is many tasks; place and count give the bucket as ntile does: the first ones hold one more.
    """
    held = df.where(F.col(column).isNotNull() & F.col("ret").isNotNull()).select("date", F.col(column).alias("_by"), "asset", "ret")
    small, more = F.floor(F.col("_total") / k), F.col("_total") % k
    of_more = more * (small + 1)
    place = F.col("_n") - 1
    bucket = F.when(place < of_more, F.floor(place / (small + 1))).otherwise(more + F.floor((place - of_more) / F.greatest(small, F.lit(1)))) + 1
    told = numbered(held, ["date"], ["_by", "asset"]).withColumn("bucket", bucket.cast("int"))
    return told.groupBy("date", "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("ret"))


def long_short(portfolios: DataFrame, name: str = "spread") -> DataFrame:
    """(date, factor, value): top bucket less bottom bucket."""
    ends = portfolios.groupBy("date").agg(F.max_by("ret", "bucket").alias("top"), F.min_by("ret", "bucket").alias("bottom"), F.max("bucket").alias("last"))
    return ends.where("last > 1").select("date", F.lit(name).alias("factor"), (F.col("top") - F.col("bottom")).alias("value"))


def momentum(rets: DataFrame, far: int, near: int) -> DataFrame:
    """rets with the compounded return from ``far`` to ``near`` periods ago; NULL until the window is full.

    A total loss in the window makes it -1; a return below -1 turns the sign of what is left.
    """
    window = by_asset().rowsBetween(-far, -near)
    full = F.count("ret").over(window) == far - near + 1
    lost, turned = (F.count(F.when(c, 1)).over(window) for c in (F.col("ret") == -1, F.col("ret") < -1))
    size = F.sum(F.when(F.col("ret") > -1, F.log1p("ret")).otherwise(F.log(F.abs(F.col("ret") + 1)))).over(window)
    value = F.when(lost > 0, -1.0).when(turned % 2 == 1, -F.exp(size) - 1).otherwise(F.expm1(size))
    return rets.withColumn("mom", F.when(full, value))


def top_residuals(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k largest absolute values of each date, ties by asset. Each task keeps k a date before they meet."""
    order = Window.partitionBy("date").orderBy(F.abs(column).desc(), "asset")
    return df.where(F.col(column).isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def factor_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both factor tables; where they share (date, factor), a's row stays."""
    order = F.min_by("value", "_from")
    both = a.select("date", "factor", "value", F.lit(0).alias("_from")).unionByName(b.select("date", "factor", "value", F.lit(1).alias("_from")))
    return both.groupBy("date", "factor").agg(order.alias("value"))


def widened(factors: DataFrame, names: list[str]) -> DataFrame:
    """One row per date with a column per factor name; dates that lack one are left out."""
    wide = factors.groupBy("date").agg(*[F.max(F.when(F.col("factor") == n, F.col("value"))).alias(n) for n in names])
    return wide.dropna(subset=names)
