"""Risk and attribution: covariances, splits, roll-ups, statistical factors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tiles import principal_components


def pairwise(series: DataFrame, key: str, value: str, how, name: str) -> DataFrame:
    """A statistic of each pair of series (key, date, value) on their common dates, keys in order.

    A row per date and pair is made on the way, so it is meant for factors; tiles.covariance_matrix is for assets.
    """
    held = with_values(series, key, value)
    return paired(held, held, F.col("x.k") <= F.col("y.k"), how, name)


def with_values(series: DataFrame, key: str, value: str) -> DataFrame:
    return series.where(F.col(value).isNotNull()).select("date", F.col(key).alias("k"), F.col(value).alias("v"))


def paired(one: DataFrame, other: DataFrame, which, how, name: str) -> DataFrame:
    x, y = one.alias("x"), other.alias("y")
    both = x.join(y, (F.col("x.date") == F.col("y.date")) & which)
    return both.groupBy(F.col("x.k").alias("f1"), F.col("y.k").alias("f2")).agg(F.count(F.lit(1)).alias("n"), how(F.col("x.v"), F.col("y.v")).alias(name))


def covariance(series: DataFrame, key: str = "factor", value: str = "value") -> DataFrame:
    """(f1, f2, n, cov), f1 <= f2: sample covariances."""
    return pairwise(series, key, value, F.covar_samp, "cov")


def covariance_block(series: DataFrame, rows: DataFrame, columns: DataFrame, key: str = "asset", value: str = "ret") -> DataFrame:
    """(f1, f2, n, cov): the covariances of the keys in rows with those in columns, one block of a matrix too large for one go.

    rows and columns are tables of keys. A pair is in the result in the order of the block, also where f1 > f2.
    """
    held = with_values(series, key, value)
    one, other = (held.join(keys.select(F.col(key).alias("k")).distinct(), "k", "left_semi") for keys in (rows, columns))
    return paired(one, other, F.lit(True), F.covar_samp, "cov")


def correlation(series: DataFrame, key: str = "factor", value: str = "value") -> DataFrame:
    """(f1, f2, n, corr), f1 <= f2."""
    return pairwise(series, key, value, F.corr, "corr")


def exposures_long(fit: DataFrame, names: list[str]) -> DataFrame:
    """(asset, factor, beta) of a fit with columns beta_..."""
    return fit.select("asset", F.inline(F.array(*[F.struct(F.lit(n).alias("factor"), F.col(f"beta_{n}").alias("beta")) for n in names])))


def risk_split(exposures: DataFrame, factor_cov: DataFrame, resid: DataFrame) -> DataFrame:
    """(asset, factor_var, resid_var, total_var): the variance that factors give each asset, and the rest.

    The two joins are on factor names, a handful, so their small side is broadcast by Spark.
    """
    whole = factor_cov.select("f1", "f2", "cov").unionByName(factor_cov.where("f1 <> f2").select(F.col("f2").alias("f1"), F.col("f1").alias("f2"), "cov"))
    one = exposures.select("asset", F.col("factor").alias("f1"), F.col("beta").alias("b1"))
    other = exposures.select("asset", F.col("factor").alias("f2"), F.col("beta").alias("b2"))
    explained = one.join(whole, "f1").join(other, ["asset", "f2"]).groupBy("asset").agg(F.sum(F.col("b1") * F.col("cov") * F.col("b2")).alias("factor_var"))
    left = resid.groupBy("asset").agg(F.var_samp("residual").alias("resid_var"))
    return explained.join(left, "asset").withColumn("total_var", F.col("factor_var") + F.col("resid_var"))


def attribution(exposures: DataFrame, factors: DataFrame) -> DataFrame:
    """(asset, date, factor, contribution): exposure times factor return."""
    return exposures.join(factors, "factor").select("asset", "date", "factor", (F.col("beta") * F.col("value")).alias("contribution"))


def attribution_rollup(attributed: DataFrame, groups: DataFrame) -> DataFrame:
    """Totals by group, asset and factor, by group and asset, by group, and over all; level is the grouping id."""
    rows = attributed.join(groups, "asset")
    return rows.rollup("grp", "asset", "factor").agg(F.sum("contribution").alias("contribution"), F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


def pca_factors(rets: DataFrame, assets: list[str] | None, k: int) -> DataFrame:
    """(component, share, asset, loading): the k leading components of all assets, or of those named.

    By subspace iteration on tiles of the pairwise complete covariance matrix; see tiles.principal_components.
    """
    held = rets if assets is None else rets.where(F.col("asset").isin(assets))
    return principal_components(held, k)
