"""One query per operator of the factor library over the stand-in panel, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import panel, regression, risk, tiles
from ..sources import panel as source
from ..sources.shared import new_folder, written
from ..streaming import bars
from ..streaming.late import run_late_bars
from . import stand_in, workloads
from .stand_in import NAMES, table

ROUND = 6


def over_returns(operator):
    """A query that hands prices and returns of the stand-in panel to operator and rounds its result."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        prices, rets = stand_in.monthly_once(spark, sf_dir)
        return workloads.rounded(operator(prices, rets), ROUND)

    return query


def sized(prices: DataFrame, rets: DataFrame) -> DataFrame:
    return rets.join(prices.select("asset", "date", "weight"), ["asset", "date"])


def fitted(prices: DataFrame, rets: DataFrame):
    """Factors and fits; factors are a few rows a date, fits one an asset, and both are read in several branches."""
    factors = written(stand_in.factors(prices, rets), "factors")
    return factors, written(regression.ols(rets, factors, NAMES), "fit")


def resid(prices: DataFrame, rets: DataFrame) -> DataFrame:
    factors, fit = fitted(prices, rets)
    return regression.residuals(rets, factors, fit, NAMES)


def attributed(prices: DataFrame, rets: DataFrame) -> DataFrame:
    factors, fit = fitted(prices, rets)
    return risk.attribution(risk.exposures_long(fit, NAMES), factors)


def split(prices: DataFrame, rets: DataFrame) -> DataFrame:
    factors, fit = fitted(prices, rets)
    return risk.risk_split(risk.exposures_long(fit, NAMES), risk.covariance(factors), regression.residuals(rets, factors, fit, NAMES))


def market(rets: DataFrame) -> DataFrame:
    return panel.market_factor(rets)


def p01_read_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").schema
    return source.read_panel(spark, f"{sf_dir}/customer.parquet", schema)


def p02_write_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "panel")
    source.write_panel(stand_in.monthly(spark, sf_dir), path)
    return spark.read.parquet(path).select("asset", "date", "price", "weight", "year")


def p03_latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return source.latest_revision(rows, ["o_custkey"], "o_orderdate")


def p05_missing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = stand_in.daily(spark, sf_dir)
    return panel.missing_cells(cells, cells)


def p08_asof_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices, _ = stand_in.monthly_once(spark, sf_dir)
    slow = prices.where(F.month("date") % 3 == 1).select("asset", F.date_add("date", 14).alias("date"), F.col("price").alias("quarter_price"))
    return panel.asof_attach(prices.select("asset", "date", "price"), slow, "quarter_price")


def p07_excess(prices: DataFrame, rets: DataFrame) -> DataFrame:
    free = rets.groupBy("date").agg((F.count(F.lit(1)) / 10000).alias("rf")).where(F.month("date") <= 10)
    return panel.excess(rets, free)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, date, ret, quantity) by day."""
    cells = written(stand_in.daily(spark, sf_dir).select("asset", "date", (F.col("value") / F.col("quantity")).alias("price"), "quantity"), "daily")
    return panel.returns(cells).join(cells.select("asset", "date", "quantity"), ["asset", "date"])


def p18_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 500 days, on the market and on the day's mean quantity, which is far from zero."""
    rets = written(daily(spark, sf_dir), "returns")
    load = rets.groupBy("date").agg(F.avg("quantity").alias("value")).select("date", F.lit("load").alias("factor"), "value")
    factors = written(panel.market_factor(rets).unionByName(load), "factors")
    return workloads.rounded(regression.rolling_ols(rets.select("asset", "date", "ret"), factors, ["mkt", "load"], 500), ROUND)


def p01_read_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), f"{new_folder(spark, 'csv')}/customers"
    rows.write.option("header", True).csv(path)
    return source.read_panel(spark, path, rows.schema, "csv")


def p04_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = stand_in.daily(spark, sf_dir).select("asset", "date", (F.col("value") / F.col("quantity")).alias("price"), F.col("quantity").alias("weight"))
    return panel.resample(cells, "month", "last")


def p30_pca(prices: DataFrame, rets: DataFrame) -> DataFrame:
    return risk.pca_factors(rets, None, 3)


def ticks(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"))


def p31_stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema, folder = table(spark, sf_dir, "events").schema, new_folder(spark, "bars")
    made = bars.run_bars(spark, sf_dir, "events.parquet", schema, ticks, f"{folder}/out", f"{folder}/state", "1 hour", "2 hours")
    return workloads.rounded(made, ROUND)


def p31_late_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the events comes after the others: what falls into bars that are final by then is dropped."""
    events, folder = table(spark, sf_dir, "events"), new_folder(spark, "late")
    for late in (False, True):
        events.where((F.col("event_id") % 5 == 0) == late).write.mode("append").parquet(f"{folder}/in")
        made = bars.run_bars(spark, f"{folder}/in", "*.parquet", events.schema, ticks, f"{folder}/out", f"{folder}/state", "1 hour", "2 hours")
    return workloads.rounded(made, ROUND)


def p31_late_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p31_late_ticks, by the step that keeps late ticks: bars, final or open, and the ticks that missed theirs, in one table."""
    events, folder = table(spark, sf_dir, "events"), new_folder(spark, "kept")
    for late in (False, True):
        events.where((F.col("event_id") % 5 == 0) == late).write.mode("append").parquet(f"{folder}/in")
        made = run_late_bars(spark, f"{folder}/in", "*.parquet", events.schema, ticks, f"{folder}/out", f"{folder}/state", "1 hour", "2 hours")
    final, open_, missed = made
    bars_ = final.withColumn("kind", F.lit("final")).unionByName(open_.withColumn("kind", F.lit("open")))
    late_ = missed.select("asset", "start", "price", F.col("seq").alias("n")).select("asset", "start", *[F.col("price").alias(c) for c in ("open", "high", "low", "close")], "n", F.lit("late").alias("kind"))
    return workloads.rounded(bars_.unionByName(late_), ROUND)


def p02_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, then corrections of the urgent ones, whose year is written anew where there are any."""
    path = f"{new_folder(spark, 'orders')}/panel"
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("asset"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("price"), F.lit(1).alias("version"), F.col("o_orderpriority").alias("priority"))
    source.upsert_panel(rows.drop("priority"), path, ["asset", "date"], "version")
    corrected = rows.where("priority = '1-URGENT'").withColumn("price", F.col("price") * 2).withColumn("version", F.lit(2))
    source.upsert_panel(corrected.drop("priority"), path, ["asset", "date"], "version")
    return spark.read.parquet(path)


def with_holes(prices: DataFrame) -> DataFrame:
    """prices with some NULL and some zero."""
    price = F.when(F.month("date") == 3, None).when((F.month("date") == 8) & F.col("asset").endswith("3"), 0.0).otherwise(F.col("price"))
    return prices.withColumn("price", price)


def with_losses(rets: DataFrame) -> DataFrame:
    """rets with some total losses and some returns below -1."""
    lost = F.when((F.month("date") == 6) & F.col("asset").endswith("3"), -1.0).when((F.month("date") % 5 == 0) & F.col("asset").endswith("4"), -1.5)
    return rets.withColumn("ret", F.coalesce(lost, F.col("ret")))


def block(prices: DataFrame, rets: DataFrame) -> DataFrame:
    first = rets.select("asset").where(F.col("asset").endswith("1"))
    return risk.covariance_block(rets, first, rets.select("asset").where(~F.col("asset").endswith("1")))


def over_workload(job):
    return lambda spark, sf_dir: workloads.rounded(job(spark, sf_dir), ROUND)


QUERIES = {
    "p01_read_panel": p01_read_panel,
    "p01_read_csv": p01_read_csv,
    "p02_write_panel": p02_write_panel,
    "p02_upsert_panel": p02_upsert,
    "p03_latest_revision": p03_latest_revision,
    "p04_resample": stand_in.monthly,
    "p04_resample_last": p04_last,
    "p05_missing_cells": p05_missing_cells,
    "p06_returns": over_returns(lambda p, r: panel.returns(p, "simple", F.lit(31))),
    "p06_returns_with_holes": over_returns(lambda p, r: panel.returns(with_holes(p))),
    "p06_log_returns": over_returns(lambda p, r: panel.returns(p, "log")),
    "p07_excess": over_returns(p07_excess),
    "p08_asof_attach": p08_asof_attach,
    "p09_winsorize": over_returns(lambda p, r: panel.winsorize(r, "ret", 0.1, 0.9)),
    "p09_winsorize_approximate": over_returns(lambda p, r: panel.winsorize(r, "ret", 0.1, 0.9, 10_000)),
    "p10_zscore": over_returns(lambda p, r: panel.zscore(r, "ret")),
    "p11_market_factor": over_returns(lambda p, r: panel.market_factor(sized(p, r), "weight")),
    "p12_sorted_portfolios": over_returns(lambda p, r: panel.sorted_portfolios(sized(p, r), "weight", 5)),
    "p13_long_short": over_returns(lambda p, r: panel.long_short(panel.sorted_portfolios(sized(p, r), "weight", 5), "size")),
    "p14_momentum": over_returns(lambda p, r: panel.momentum(r, 12, 2)),
    "p14_momentum_with_losses": over_returns(lambda p, r: panel.momentum(with_losses(r), 12, 2)),
    "p15_beta": over_returns(lambda p, r: regression.beta(r, market(r))),
    "p16_rolling_beta": over_returns(lambda p, r: regression.rolling_beta(r, market(r), 12)),
    "p17_ols": over_returns(lambda p, r: fitted(p, r)[1]),
    "p18_rolling_ols": over_returns(lambda p, r: regression.rolling_ols(r, stand_in.factors(p, r), NAMES, 24)),
    "p18_rolling_ols_wide": p18_wide,
    "p19_residuals": over_returns(resid),
    "p20_idio_vol": over_returns(lambda p, r: regression.idio_vol(resid(p, r), 12)),
    "p21_fama_macbeth": over_returns(lambda p, r: regression.fama_macbeth(r, fitted(p, r)[1].select("asset", "beta_mkt"), ["mkt"])),
    "p22_newey_west": over_returns(lambda p, r: regression.newey_west(market(r), "value", 4)),
    "p23_covariance": over_returns(lambda p, r: risk.covariance(r, "asset", "ret")),
    "p23_covariance_block": over_returns(block),
    "p23_covariance_tiles": over_returns(lambda p, r: tiles.covariance_matrix(r, block=8, span=32)),
    "p24_correlation_tiles": over_returns(lambda p, r: tiles.correlation_matrix(r, block=8, span=32)),
    "p24_correlation": over_returns(lambda p, r: risk.correlation(r, "asset", "ret")),
    "p25_risk_split": over_returns(split),
    "p26_attribution": over_returns(attributed),
    "p27_attribution_rollup": over_returns(lambda p, r: risk.attribution_rollup(attributed(p, r), r.select("asset", F.substring("asset", 1, 7).alias("grp")).distinct())),
    "p28_top_residuals": over_returns(lambda p, r: panel.top_residuals(resid(p, r), "residual", 3)),
    "p29_factor_union": over_returns(lambda p, r: panel.factor_union(market(r), panel.market_factor(sized(p, r), "weight").unionByName(panel.long_short(panel.sorted_portfolios(sized(p, r), "weight", 5), "size")))),
    "p30_pca_factors": over_returns(p30_pca),
    "p31_stream_bars": p31_stream_bars,
    "p31_late_ticks": p31_late_ticks,
    "p31_late_table": p31_late_table,
    "wa_rolling_exposures": over_workload(workloads.rolling_exposures),
    "wb_priced_factors": over_workload(workloads.priced_factors),
    "wc_risk_and_attribution": over_workload(workloads.risk_and_attribution),
}


def over_panel(select: str) -> str:
    return f"with {stand_in.SQL} {select}"


def r6(*columns: str) -> str:
    return ", ".join(f"round({c.split(' as ')[0]}, {ROUND}) + 0.0 as {c.split(' as ')[-1]}" for c in columns)


def pca_sql(k: int, squarings: int = 14) -> str:
    """Components by repeated squaring: a power of the matrix, its trace held at 1, goes to v v' of its largest eigenvalue, which is then taken out."""
    parts = ["c0 as materialized (select x.asset as i, y.asset as j, covar_samp(x.ret, y.ret) as v from r x join r y on x.date = y.date group by 1, 2)"]
    for c in range(k):
        parts.append(f"s{c}_0 as materialized (select i, j, v / (select sum(v) from c{c} where i = j) as v from c{c})")
        for m in range(squarings):
            parts.append(f"q{c}_{m} as materialized (select a.i, b.j, sum(a.v * b.v) as v from s{c}_{m} a join s{c}_{m} b on a.j = b.i group by 1, 2)")
            parts.append(f"s{c}_{m + 1} as materialized (select i, j, v / (select sum(v) from q{c}_{m} where i = j) as v from q{c}_{m})")
        last = f"s{c}_{squarings}"
        parts.append(f"l{c} as materialized (select sum(p.v * c.v) as v from {last} p join c{c} c on c.i = p.i and c.j = p.j)")
        parts.append(f"v{c} as materialized (select i as asset, v / sqrt((select max(v) from {last} where i = j)) as v from {last} where j = (select arg_max(i, v) from {last} where i = j))")
        parts.append(f"c{c + 1} as materialized (select c.i, c.j, c.v - (select v from l{c}) * p.v as v from c{c} c join {last} p on p.i = c.i and p.j = c.j)")
    rows = [f"select {c + 1} as component, (select v from l{c}) / (select sum(v) from c0 where i = j) as share, asset, v * (select sign(sum(v)) from v{c}) as loading from v{c}" for c in range(k)]
    return over_panel(f"{', '.join(parts)} select component, {r6('share')}, asset, {r6('loading')} from ({' union all '.join(rows)})").replace(" c0 as", ", c0 as", 1)


W12 = "partition by asset order by date rows between 11 preceding and current row"
W24 = "partition by asset order by date rows between 23 preceding and current row"

SQL = {
    "p01_read_panel": "select c_custkey, c_mktsegment, c_acctbal from customer",
    "p02_write_panel": over_panel("select asset, date, price, weight, cast(year(date) as integer) as year from px"),
    "p03_latest_revision": """select o_custkey, o_orderdate, o_orderkey, o_totalprice from (
      select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc, o_totalprice desc) as i from orders) where i = 1""",
    "p04_resample": over_panel("select asset, date, price, weight from px"),
    "p05_missing_cells": """with d as (select distinct p_brand as asset, cast(l_shipdate as date) as date from lineitem join part on l_partkey = p_partkey)
      select a.asset, c.date from (select distinct asset from d) a cross join (select distinct date from d) c anti join d on d.asset = a.asset and d.date = c.date""",
    "p06_returns": over_panel(f"""select asset, date, {r6('ret')} from (select asset, date, lag(price) over w is null as first,
      case when date - lag(date) over w <= 31 then price / lag(price) over w - 1 end as ret from px window w as (partition by asset order by date)) where not first"""),
    "p06_returns_with_holes": over_panel(f"""select asset, date, {r6('ret')} from (select asset, date, row_number() over w as i, price / nullif(lag(price) over w, 0) - 1 as ret
      from (select asset, date, case when month(date) = 3 then null when month(date) = 8 and asset like '%3' then 0 else price end as price from px) window w as (partition by asset order by date)) where i > 1"""),
    "p06_log_returns": over_panel(f"select asset, date, {r6('ln(1 + ret) as ret')} from r"),
    "p07_excess": over_panel(f"""select asset, r.date, {r6('ret - rf as ret')} from r left join (select date, count(*) / 10000 as rf from r group by 1 having month(date) <= 10) q on q.date = r.date"""),
    "p08_asof_attach": over_panel("""select p.asset, p.date, p.price, s.price as quarter_price from px p asof left join
      (select asset, date + 14 as at, price from px where month(date) % 3 = 1) s on s.asset = p.asset and p.date >= s.at"""),
    "p09_winsorize": over_panel(f"""select asset, r.date, {r6('greatest(lo, least(hi, ret)) as ret')} from r join
      (select date, quantile_cont(ret, 0.1) as lo, quantile_cont(ret, 0.9) as hi from r group by 1) q on q.date = r.date"""),
    "p09_winsorize_approximate": over_returns(lambda p, r: panel.winsorize(r, "ret", 0.1, 0.9, 10_000)),
    "p10_zscore": over_panel(f"""select asset, r.date, {r6('ret', 'case when dev > 0 then (ret - mean) / dev end as z')} from r join
      (select date, avg(ret) as mean, case when count(*) > 1 then stddev_samp(ret) end as dev from r group by 1) q on q.date = r.date"""),
    "p11_market_factor": over_panel(f"select date, 'mkt' as factor, {r6('value')} from (select date, sum(weight * ret) / sum(weight) as value from r group by 1)"),
    "p12_sorted_portfolios": over_panel(f"select date, cast(bucket as integer) as bucket, n, {r6('ret')} from pf"),
    "p13_long_short": over_panel(f"select date, 'size' as factor, {r6('size as value')} from ls"),
    "p14_momentum": over_panel(f"""select asset, date, {r6('ret', 'mom')} from (select asset, date, ret,
      case when count(ret) over w = 11 then exp(sum(ln(1 + ret)) over w) - 1 end as mom from r window w as (partition by asset order by date rows between 12 preceding and 2 preceding))"""),
    "p14_momentum_with_losses": over_panel(f"""select asset, date, {r6('ret', 'mom')} from (select asset, date, ret, case when count(ret) over w = 11 then product(1 + ret) over w - 1 end as mom from (
      select asset, date, case when month(date) = 6 and asset like '%3' then -1.0 when month(date) % 5 = 0 and asset like '%4' then -1.5 else ret end as ret from r)
      window w as (partition by asset order by date rows between 12 preceding and 2 preceding))"""),
    "p15_beta": over_panel(f"""select asset, n, {r6('beta', 'alpha', 'r2')} from (select asset, count(*) as n, case when count(*) > 1 then regr_slope(ret, mkt) end as beta,
      case when count(*) > 1 then regr_intercept(ret, mkt) end as alpha, case when count(*) > 1 then regr_r2(ret, mkt) end as r2 from r join mkt using (date) group by 1)"""),
    "p16_rolling_beta": over_panel(f"""select asset, date, {r6('beta')} from (select asset, date,
      case when count(ret) over w = 12 then regr_slope(ret, mkt) over w end as beta from r join mkt using (date) window w as ({W12}))"""),
    "p17_ols": over_panel(f"select asset, n, {r6('alpha', 'beta_mkt', 'beta_size')} from ols"),
    "p18_rolling_ols": over_panel(f"""select asset, date, n, {r6('case when n = 24 then yb - b1 * x1 - b2 * x2 end as alpha', 'case when n = 24 then b1 end as beta_mkt', 'case when n = 24 then b2 end as beta_size')} from (
      select *, (y1 * v2 - y2 * v12) / (v1 * v2 - v12 * v12) as b1, (y2 * v1 - y1 * v12) / (v1 * v2 - v12 * v12) as b2 from (
      select asset, date, count(*) over w as n, avg(ret) over w as yb, avg(mkt) over w as x1, avg(size) over w as x2, covar_pop(ret, mkt) over w as y1, covar_pop(ret, size) over w as y2,
      var_pop(mkt) over w as v1, var_pop(size) over w as v2, covar_pop(mkt, size) over w as v12 from m window w as ({W24})))"""),
    "p18_rolling_ols_wide": p18_wide,
    "p19_residuals": over_panel(f"select asset, date, {r6('residual')} from res"),
    "p20_idio_vol": over_panel(f"select asset, date, {r6('vol')} from (select asset, date, case when count(residual) over w = 12 then stddev_samp(residual) over w end as vol from res window w as ({W12}))"),
    "p21_fama_macbeth": over_panel(f"""select factor, count(p) as n, {r6('avg(p) as mean', 'stddev_samp(p) as dev', 'avg(p) / (stddev_samp(p) / sqrt(count(p))) as t')} from (
      select date, unnest(['0', 'mkt']) as factor, unnest([regr_intercept(ret, beta_mkt), regr_slope(ret, beta_mkt)]) as p from r join ols using (asset) group by date) group by 1"""),
    "p22_newey_west": over_panel(f"""select n, {r6('mean', 'variance', 'case when variance > 0 then mean / sqrt(variance) end as t')} from (
      select count(*) as n, any_value(mean) as mean, (sum(e * e) + 2 * (0.8 * coalesce(sum(e * e1), 0) + 0.6 * coalesce(sum(e * e2), 0) + 0.4 * coalesce(sum(e * e3), 0) + 0.2 * coalesce(sum(e * e4), 0))) / count(*) / count(*) as variance
      from (select mean, e, lag(e, 1) over w as e1, lag(e, 2) over w as e2, lag(e, 3) over w as e3, lag(e, 4) over w as e4
        from (select date, mkt - avg(mkt) over () as e, avg(mkt) over () as mean from mkt) window w as (order by date)))"""),
    "p23_covariance": over_panel(f"select x.asset as f1, y.asset as f2, count(*) as n, {r6('covar_samp(x.ret, y.ret) as cov')} from r x join r y on x.date = y.date and x.asset <= y.asset group by 1, 2"),
    "p23_covariance_block": over_panel(f"""select x.asset as f1, y.asset as f2, count(*) as n, {r6('covar_samp(x.ret, y.ret) as cov')} from r x join r y on x.date = y.date
      where x.asset like '%1' and y.asset not like '%1' group by 1, 2"""),
    "p23_covariance_tiles": over_returns(lambda p, r: tiles.covariance_matrix(r, block=8, span=32)),
    "p24_correlation_tiles": over_returns(lambda p, r: tiles.correlation_matrix(r, block=8, span=32)),
    "p24_correlation": over_panel(f"select x.asset as f1, y.asset as f2, count(*) as n, {r6('corr(x.ret, y.ret) as corr')} from r x join r y on x.date = y.date and x.asset <= y.asset group by 1, 2"),
    "p25_risk_split": over_panel(f"""select asset, {r6('factor_var', 'resid_var', 'factor_var + resid_var as total_var')} from (
      select asset, beta_mkt * beta_mkt * c11 + 2 * beta_mkt * beta_size * c12 + beta_size * beta_size * c22 as factor_var, resid_var from ols
      join (select asset, var_samp(residual) as resid_var from res group by 1) using (asset),
      (select var_samp(mkt) as c11 from mkt), (select var_samp(size) as c22 from ls), (select covar_samp(mkt, size) as c12 from f))"""),
    "p26_attribution": over_panel(f"""select asset, date, factor, {r6("case when factor = 'mkt' then beta_mkt else beta_size end * value as contribution")} from ols cross join fl"""),
    "p27_attribution_rollup": over_panel(f"""select grp, asset, factor, {r6('contribution')}, n, level from (
      select substr(asset, 1, 7) as grp, asset, factor, sum(case when factor = 'mkt' then beta_mkt else beta_size end * value) as contribution, count(*) as n,
      cast(grouping(substr(asset, 1, 7), asset, factor) as bigint) as level from ols cross join fl group by rollup (substr(asset, 1, 7), asset, factor))"""),
    "p28_top_residuals": over_panel(f"""select asset, date, {r6('residual')}, cast(i as integer) as rank from (
      select *, row_number() over (partition by date order by abs(residual) desc, asset) as i from res) where i <= 3"""),
    "p29_factor_union": over_panel(f"select date, factor, {r6('value')} from fl"),
    "p31_stream_bars": f"""with t as (select event_type as asset, time_bucket(interval '1 hour', ts) as start, ts, event_id, value from events)
      select asset, start, {r6('arg_min(value, (ts, event_id)) as open', 'max(value) as high', 'min(value) as low', 'arg_max(value, (ts, event_id)) as close')}, count(*) as n
      from t group by 1, 2 having start + interval '1 hour' <= (select max(ts) - interval '2 hours' from events)""",
    "p31_late_ticks": f"""with t as (select event_type as asset, time_bucket(interval '1 hour', ts) as start, ts, event_id, value from events),
      k as (select * from t where event_id % 5 <> 0 or start + interval '1 hour' > (select max(ts) - interval '2 hours' from events where event_id % 5 <> 0))
      select asset, start, {r6('arg_min(value, (ts, event_id)) as open', 'max(value) as high', 'min(value) as low', 'arg_max(value, (ts, event_id)) as close')}, count(*) as n
      from k group by 1, 2 having start + interval '1 hour' <= (select max(ts) - interval '2 hours' from events)""",
    "wb_priced_factors": over_panel(f"""select factor, count(p) as n, {r6('avg(p) as mean', 'stddev_samp(p) as dev', 'avg(p) / (stddev_samp(p) / sqrt(count(p))) as t')} from (
      select date, unnest(['0', 'mkt', 'size']) as factor, unnest([yb - p1 * x1 - p2 * x2, p1, p2]) as p from (
      select date, yb, x1, x2, (y1 * v2 - y2 * v12) / (v1 * v2 - v12 * v12) as p1, (y2 * v1 - y1 * v12) / (v1 * v2 - v12 * v12) as p2 from (
      select date, avg(ret) as yb, avg(beta_mkt) as x1, avg(beta_size) as x2, covar_pop(ret, beta_mkt) as y1, covar_pop(ret, beta_size) as y2, var_pop(beta_mkt) as v1, var_pop(beta_size) as v2,
      covar_pop(beta_mkt, beta_size) as v12 from r join ols using (asset) group by date having count(*) > 2))) group by 1"""),
}


SQL |= {
    "p01_read_csv": SQL["p01_read_panel"],
    "p02_upsert_panel": """select o_orderkey as asset, cast(o_orderdate as date) as date, case when o_orderpriority = '1-URGENT' then o_totalprice * 2 else o_totalprice end as price,
      case when o_orderpriority = '1-URGENT' then 2 else 1 end::integer as version, cast(year(o_orderdate) as integer) as year from orders""",
    "p31_late_table": f"""with t as (select event_type as asset, time_bucket(interval '1 hour', ts) as start, ts, event_id, value, event_id % 5 <> 0 as early from events),
      e as (select max(ts) filter (early) - interval '2 hours' as first, max(ts) - interval '2 hours' as second from t),
      k as (select t.*, early or start + interval '1 hour' > e.first as held from t, e),
      b as (select asset, start, arg_min(value, (ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, (ts, event_id)) as close, count(*) as n,
        case when start + interval '1 hour' <= any_value(e.second) then 'final' else 'open' end as kind from k, e where held group by 1, 2
        union all select asset, start, value, value, value, value, event_id, 'late' from k where not held)
      select asset, start, {r6('open', 'high', 'low', 'close')}, n, kind from b""",
    "p04_resample_last": """with d as (select p_brand as asset, cast(l_shipdate as date) as date, sum(cast(round(l_extendedprice * 100) as bigint)) / sum(l_quantity) as price, sum(l_quantity) as weight
      from lineitem join part on l_partkey = p_partkey group by 1, 2)
      select asset, cast(date_trunc('month', date) as date) as date, arg_max(price, d.date) as price, arg_max(weight, d.date) as weight from d group by 1, 2""",
    "p09_winsorize_approximate": over_panel(f"""select asset, r.date, {r6('greatest(lo, least(hi, ret)) as ret')} from r join
      (select date, quantile_disc(ret, 0.1) as lo, quantile_disc(ret, 0.9) as hi from r group by 1) q on q.date = r.date"""),
    "p18_rolling_ols_wide": f"""with d as (select p_brand as asset, cast(l_shipdate as date) as date, sum(cast(round(l_extendedprice * 100) as bigint)) / sum(l_quantity) as price, sum(l_quantity) as quantity
      from lineitem join part on l_partkey = p_partkey group by 1, 2),
      r0 as (select asset, date, quantity, price / lag(price) over (partition by asset order by date) - 1 as ret from d), r as (select * from r0 where ret is not null),
      f as (select date, avg(ret) as mkt, avg(quantity) as load from r group by 1), m as (select asset, date, ret, mkt, load from r join f using (date))
      select asset, date, n, {r6('case when n = 500 then yb - b1 * x1 - b2 * x2 end as alpha', 'case when n = 500 then b1 end as beta_mkt', 'case when n = 500 then b2 end as beta_load')} from (
      select *, (y1 * v2 - y2 * v12) / (v1 * v2 - v12 * v12) as b1, (y2 * v1 - y1 * v12) / (v1 * v2 - v12 * v12) as b2 from (
      select asset, date, count(*) over w as n, avg(ret) over w as yb, avg(mkt) over w as x1, avg(load) over w as x2, covar_pop(ret, mkt) over w as y1, covar_pop(ret, load) over w as y2,
      var_pop(mkt) over w as v1, var_pop(load) over w as v2, covar_pop(mkt, load) over w as v12 from m window w as (partition by asset order by date rows between 499 preceding and current row)))""",
    "p23_covariance_tiles": SQL["p23_covariance"],
    "p24_correlation_tiles": SQL["p24_correlation"],
    "p30_pca_factors": pca_sql(3),
    "wa_rolling_exposures": f"select *, cast(year(date) as integer) as year from ({SQL['p18_rolling_ols']})",
    "wc_risk_and_attribution": f"""select a.*, s.factor_var, s.resid_var, s.total_var, v.vol from ({SQL['p27_attribution_rollup']}) a
      left join ({SQL['p25_risk_split']}) s on s.asset = a.asset and a.level = 1 left join (select asset, arg_max(vol, date) as vol from ({SQL['p20_idio_vol']}) group by 1) v on v.asset = a.asset and a.level = 1""",
}


def queries():
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
