"""Regressions over panels: full sample, rolling, cross-sectional."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.moments import moments, rolled, system
from ..functions.ranges import numbered
from ..functions.solve import solve_gram
from ..sources.shared import checkpointed
from .panel import widened


def with_factor(rets: DataFrame, factor: DataFrame) -> DataFrame:
    """rets with the value of a one-factor table (date, value) as x."""
    return rets.join(factor.select("date", F.col("value").alias("x")), "date")


def beta(rets: DataFrame, factor: DataFrame) -> DataFrame:
    """Per asset: n, beta, alpha, r2 of its returns on one factor; NULL with fewer than two dates or a constant factor."""
    held = with_factor(rets, factor).where("ret is not null and x is not null")
    fit = held.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("ret", "x").alias("beta"), F.regr_intercept("ret", "x").alias("alpha"), F.regr_r2("ret", "x").alias("r2"))
    return fit.select("asset", "n", *[F.when(F.col("n") > 1, F.col(c)).alias(c) for c in ("beta", "alpha", "r2")])


def rolling_beta(rets: DataFrame, factor: DataFrame, width: int) -> DataFrame:
    """(asset, date, beta): the slope over the last ``width`` rows, NULL until there are so many returns and for a constant factor."""
    told = rolled(with_factor(rets, factor), "asset", "date", ["x", "ret"], width)
    slope = F.when((F.col("_rolled.n") == width) & (F.col("_rolled.c_0_0") > 0), F.col("_rolled.c_0_1") / F.col("_rolled.c_0_0"))
    return told.select("asset", "date", slope.alias("beta"))


def fitted(of: Column, names: list[str], when: Column) -> Column:
    """The slopes of ret on names, of moments of names and ret; NULL unless when."""
    gram, right = system(of, len(names))
    return F.when(when, solve_gram(gram, right))


def unpacked(fit: DataFrame, keys: list[str], names: list[str], prefix: str = "beta_", intercept: str = "alpha") -> DataFrame:
    """Intercept and slopes of rows with moments _of and slopes x."""
    k = len(names)
    alpha = F.col(f"_of.m_{k}")
    for i in range(k):
        alpha = alpha - F.col("x")[i] * F.col(f"_of.m_{i}")
    return fit.select(*keys, F.col("_of.n").alias("n"), alpha.alias(intercept), *[F.col("x")[i].alias(f"{prefix}{n}") for i, n in enumerate(names)])


def ols(rets: DataFrame, factors: DataFrame, names: list[str]) -> DataFrame:
    """Per asset: n, alpha and a beta per factor. Centred sums are aggregated natively; only k x k systems reach Python.

    NULL coefficients for collinear or constant factors and for no more rows than coefficients but one.
    """
    held = rets.where("ret is not null").join(widened(factors, names), "date")
    added = held.groupBy("asset").agg(moments([*names, "ret"]).alias("_of"))
    return unpacked(added.withColumn("x", fitted(F.col("_of"), names, F.col("_of.n") > len(names))), ["asset"], names)


def rolling_ols(rets: DataFrame, factors: DataFrame, names: list[str], width: int) -> DataFrame:
    """Per asset and date: the fit over the last ``width`` rows, NULL until there are so many.

    Frames are merged of two running blocks, so their cost does not grow with width, and no running
    sums are subtracted, which would lose digits.
    """
    held = rets.where("ret is not null").join(widened(factors, names), "date")
    told = rolled(held, "asset", "date", [*names, "ret"], width).withColumnRenamed("_rolled", "_of")
    return unpacked(told.withColumn("x", fitted(F.col("_of"), names, F.col("_of.n") == width)), ["asset", "date"], names)


def residuals(rets: DataFrame, factors: DataFrame, fit: DataFrame, names: list[str]) -> DataFrame:
    """(asset, date, residual): what the factors of a full-sample fit leave of each return."""
    explained = F.col("alpha")
    for n in names:
        explained = explained + F.col(f"beta_{n}") * F.col(n)
    both = rets.join(widened(factors, names), "date").join(fit.drop("n"), "asset")
    return both.select("asset", "date", (F.col("ret") - explained).alias("residual"))


def idio_vol(resid: DataFrame, width: int) -> DataFrame:
    """(asset, date, vol): the sample deviation of the last ``width`` residuals, NULL until there are so many."""
    told = rolled(resid, "asset", "date", ["residual"], width)
    dev = F.sqrt(F.greatest(F.lit(0.0), F.col("_rolled.c_0_0")) / F.nullif(F.col("_rolled.n") - 1, F.lit(0)))
    return told.select("asset", "date", F.when(F.col("_rolled.n") == width, dev).alias("vol"))


def cross_sections(rets: DataFrame, exposures: DataFrame, names: list[str]) -> DataFrame:
    """(date, n, lambda_...): each date's regression of returns on exposures (asset, beta_...)."""
    betas = [f"beta_{n}" for n in names]
    held = rets.where("ret is not null").join(exposures.dropna(subset=betas).select("asset", *betas), "asset")
    added = held.groupBy("date").agg(moments([*betas, "ret"]).alias("_of"))
    solved = added.withColumn("x", fitted(F.col("_of"), betas, F.col("_of.n") > len(names)))
    return unpacked(solved, ["date"], names, "lambda_", "lambda_0")


def fama_macbeth(rets: DataFrame, exposures: DataFrame, names: list[str]) -> DataFrame:
    """(factor, n, mean, dev, t): the mean of the dates' premia, their deviation and t value."""
    premia = cross_sections(rets, exposures, names)
    long = premia.select("date", F.inline(F.array(*[F.struct(F.lit(n).alias("factor"), F.col(f"lambda_{n}").alias("p")) for n in ["0", *names]])))
    out = long.groupBy("factor").agg(F.count("p").alias("n"), F.avg("p").alias("mean"), F.stddev_samp("p").alias("dev"))
    return out.withColumn("t", F.try_divide(F.col("mean"), F.col("dev") / F.sqrt("n")))


def newey_west(series: DataFrame, column: str, lags: int) -> DataFrame:
    """One row: n, mean, its variance with Bartlett weights, and t; no rows without a value.

    Dates are numbered over ranges, and each value meets those up to ``lags`` behind it by number.
    """
    held = series.where(F.col(column).isNotNull()).select("date", F.col(column).alias("v"))
    rows = checkpointed(numbered(held, [], ["date", "v"]))
    mean = rows.agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n"))
    centred = rows.crossJoin(F.broadcast(mean)).select("_n", (F.col("v") - F.col("mean")).alias("e"))  # mean is one row
    behind = centred.select(F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("k"), (F.col("_n")).alias("_at"), F.col("e").alias("f")).withColumn("_n", F.col("_at") + F.col("k"))
    weight = F.when(F.col("k") == 0, 1.0).otherwise(2 * (1 - F.col("k") / (lags + 1)))
    total = centred.join(behind, "_n").agg(F.sum(weight * F.col("e") * F.col("f")).alias("long"))
    out = mean.crossJoin(total).where("n > 0").select("n", "mean", (F.col("long") / F.col("n") / F.col("n")).alias("variance"))
    return out.withColumn("t", F.when(F.col("variance") > 0, F.col("mean") / F.sqrt("variance")))
