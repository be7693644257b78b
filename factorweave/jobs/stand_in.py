"""A stand-in panel from the order tables, which hold no market prices: brands as assets, price per unit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import panel
from ..sources.shared import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, date, value, quantity): each brand's sales of a day, the value in whole cents so that sums are exact."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_shipdate").cast("date").alias("date"), "l_extendedprice", "l_quantity")
    brands = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("asset"))
    both = items.join(brands, items["l_partkey"] == brands["p_partkey"])
    return both.groupBy("asset", "date").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("value"), F.sum("l_quantity").alias("quantity"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, date, price, weight) by month."""
    return panel.resample(daily(spark, sf_dir), "month", "ratio")


def monthly_once(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Monthly prices, written once because regressions and factors read them in many branches, and their returns."""
    prices = written(monthly(spark, sf_dir), "monthly")
    return prices, panel.returns(prices)


def monthly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, date, ret) by month; the one gap gives a return over two months."""
    return panel.returns(monthly(spark, sf_dir))


def factors(prices: DataFrame, rets: DataFrame) -> DataFrame:
    """(date, factor, value): the market, and large less small brands by the weight of the month."""
    sized = rets.join(prices.select("asset", "date", "weight"), ["asset", "date"])
    return panel.factor_union(panel.market_factor(rets), panel.long_short(panel.sorted_portfolios(sized, "weight", 5), "size"))


NAMES = ["mkt", "size"]

SQL = """
px as (
  select p_brand as asset, cast(date_trunc('month', l_shipdate) as date) as date, sum(cast(round(l_extendedprice * 100) as bigint)) / sum(l_quantity) as price, sum(l_quantity) as weight
  from lineitem join part on l_partkey = p_partkey group by 1, 2),
r0 as (select asset, date, price / lag(price) over (partition by asset order by date) - 1 as ret, weight from px),
r as (select * from r0 where ret is not null),
mkt as (select date, avg(ret) as mkt from r group by 1),
b as (select *, ntile(5) over (partition by date order by weight, asset) as bucket from r),
pf as (select date, bucket, count(*) as n, avg(ret) as ret from b group by 1, 2),
ls as (select date, max_by(ret, bucket) - min_by(ret, bucket) as size from pf group by 1 having max(bucket) > 1),
f as (select date, mkt, size from mkt join ls using (date)),
fl as (select date, 'mkt' as factor, mkt as value from mkt union all select date, 'size', size from ls),
m as (select r.asset, r.date, r.ret, f.mkt, f.size from r join f using (date)),
c as (select asset, count(*) as n, avg(ret) as yb, avg(mkt) as b1, avg(size) as b2, covar_pop(ret, mkt) as y1, covar_pop(ret, size) as y2,
  var_pop(mkt) as v1, var_pop(size) as v2, covar_pop(mkt, size) as v12 from m group by 1),
fit as (
  select asset, n, (y1 * v2 - y2 * v12) / (v1 * v2 - v12 * v12) as beta_mkt, (y2 * v1 - y1 * v12) / (v1 * v2 - v12 * v12) as beta_size, yb, b1, b2 from c),
ols as (select asset, n, yb - beta_mkt * b1 - beta_size * b2 as alpha, beta_mkt, beta_size from fit),
res as (select asset, date, ret - alpha - beta_mkt * mkt - beta_size * size as residual from m join ols using (asset))
"""
