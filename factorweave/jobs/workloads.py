"""The three workloads: rolling exposures, priced factors, risk and attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import panel, regression, risk
from ..sources.panel import write_panel
from ..sources.shared import new_folder, written
from . import stand_in


def market_betas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: each asset's market beta over the whole sample."""
    rets = stand_in.monthly_returns(spark, sf_dir)
    return regression.beta(rets, panel.market_factor(rets))


def rolling_exposures(spark: SparkSession, sf_dir: str, width: int = 24) -> DataFrame:
    """A: two-factor exposures over trailing windows, stored by year and read back."""
    prices, rets = stand_in.monthly_once(spark, sf_dir)
    path = f"{new_folder(spark, 'exposures')}/panel"
    write_panel(regression.rolling_ols(rets, stand_in.factors(prices, rets), stand_in.NAMES, width), path)
    return spark.read.parquet(path)


def priced_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B: exposures, then cross-sections by date, then their means and t values."""
    prices, rets = stand_in.monthly_once(spark, sf_dir)
    fit = regression.ols(rets, stand_in.factors(prices, rets), stand_in.NAMES)
    return regression.fama_macbeth(rets, fit, stand_in.NAMES)


def risk_and_attribution(spark: SparkSession, sf_dir: str, width: int = 12) -> DataFrame:
    """C: what the factors gave each group, asset and factor, and beside each asset its variances and its latest residual deviation.

    Rows of other levels than an asset's own have no variances.
    """
    prices, rets = stand_in.monthly_once(spark, sf_dir)
    factors = written(stand_in.factors(prices, rets), "factors")
    fit = written(regression.ols(rets, factors, stand_in.NAMES), "fit")
    resid = written(regression.residuals(rets, factors, fit, stand_in.NAMES), "residuals")
    exposures = risk.exposures_long(fit, stand_in.NAMES)
    split = risk.risk_split(exposures, risk.covariance(factors), resid)
    latest = regression.idio_vol(resid, width).groupBy("asset").agg(F.max_by("vol", "date").alias("vol"))
    groups = fit.select("asset", F.substring("asset", 1, 7).alias("grp"))
    total = risk.attribution_rollup(risk.attribution(exposures, factors), groups)
    of_asset = split.join(latest, "asset").withColumn("level", F.lit(1).cast("long"))
    return total.join(of_asset, ["asset", "level"], "left")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with its doubles rounded, a negative zero as zero, for comparison with other engines."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
