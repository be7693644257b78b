"""Operators that split what one task held before: tiles, ranges, rolling moments, exact quantiles, upserts, late ticks."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorweave.functions import ranges, selection, solve
from factorweave.operators import panel, regression, risk, tiles
from factorweave.sources import panel as source
from factorweave.streaming import late

DAYS = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(700)]


@pytest.fixture(autouse=True)
def uncoalesced(spark):
    """Small partitions stay apart, so that splits show on few rows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def panel_of(spark, values):
    """A panel of a matrix of dates by assets, NaN where there is no row."""
    rows = [(f"a{j:04d}", DAYS[i], float(values[i, j])) for i, j in zip(*np.nonzero(~np.isnan(values)))]
    return spark.createDataFrame(rows, source.RETURNS)


def pairwise(values):
    """The pairwise complete covariance matrix, by numpy."""
    n = values.shape[1]
    out = np.full((n, n), np.nan)
    for i in range(n):
        for j in range(n):
            both = ~np.isnan(values[:, i]) & ~np.isnan(values[:, j])
            if both.sum() > 1:
                out[i, j] = np.cov(values[both, i], values[both, j])[0, 1]
    return out


@pytest.fixture(scope="module")
def holes():
    rng = np.random.default_rng(0)
    values = rng.normal(size=(40, 23)) + rng.normal(size=(40, 1)) * rng.uniform(0, 2, 23) + 1e5 * np.arange(23)
    values[rng.random(values.shape) < 0.2] = np.nan
    values[:, 5] = np.nan
    values[3, 5] = 1.0
    values[:, 7] = 2.0
    return values


def test_tiles_equal_the_pairs_that_numpy_finds(spark, holes):
    rets = panel_of(spark, holes)
    made = tiles.covariance_matrix(rets, block=5, span=7, group=2).collect()
    cov = pairwise(holes)
    assert {(r["f1"], r["f2"]) for r in made} == {(f"a{i:04d}", f"a{j:04d}") for i in range(23) for j in range(i, 23) if (~np.isnan(holes[:, i]) & ~np.isnan(holes[:, j])).any()}
    for r in made:
        i, j = int(r["f1"][1:]), int(r["f2"][1:])
        assert r["n"] == (~np.isnan(holes[:, i]) & ~np.isnan(holes[:, j])).sum()
        assert r["cov"] is None if r["n"] < 2 else np.isclose(r["cov"], cov[i, j], atol=1e-8)
    corr = {(r["f1"], r["f2"]): r["corr"] for r in tiles.correlation_matrix(rets, block=5, span=7).collect()}
    pairs = {(r["f1"], r["f2"]): r["corr"] for r in risk.correlation(rets.where("asset not in ('a0005', 'a0007')"), "asset", "ret").collect()}
    assert all(np.isclose(corr[k], v, atol=1e-6) for k, v in pairs.items()) and corr["a0007", "a0007"] is None


def test_no_step_of_the_tiles_has_a_row_per_date_and_pair(spark):
    """60 assets on 200 dates: 366,000 pairs of cells, 12,000 cells, 78 tiles."""
    values = np.random.default_rng(1).normal(size=(200, 60))
    made, _ = tiles.tiles(panel_of(spark, values), "asset", "ret", block=5, span=50)
    plan = made._jdf.queryExecution().toString()
    assert "Join" not in plan.split("== Physical Plan ==")[1] and made.count() <= 13 * 14 / 2 + 13


def test_components_of_many_assets_equal_numpy(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(size=(150, 12)) @ (rng.normal(size=(12, 400)) * np.linspace(2, 0.3, 12)[:, None]) + rng.normal(size=(150, 400)) + 3
    values[rng.random(values.shape) < 0.05] = np.nan
    found = risk.pca_factors(panel_of(spark, values), None, 3).toPandas()
    cov = pairwise(values)
    w, v = np.linalg.eigh(cov)
    for c in range(3):
        own = found[found["component"] == c + 1].sort_values("asset")
        assert len(own) == 400 and np.isclose(own["share"].iloc[0], w[-1 - c] / np.trace(cov), rtol=1e-9)
        want = v[:, -1 - c] * np.sign(v[:, -1 - c].sum())
        assert np.allclose(own["loading"], want, atol=1e-6)


def test_components_without_a_common_date_or_any_row(spark):
    """No date has all assets, which a complete-case matrix would need."""
    values = np.random.default_rng(3).normal(size=(60, 6))
    for i in range(60):
        values[i, i % 6] = np.nan
    found = risk.pca_factors(panel_of(spark, values), None, 2).collect()
    assert len(found) == 12 and np.isclose(sum(r["loading"] ** 2 for r in found), 2)
    assert risk.pca_factors(panel_of(spark, values).limit(0), None, 2).collect() == []
    assert risk.pca_factors(panel_of(spark, values[:1]), None, 2).collect() == []


def test_numbers_and_values_are_carried_over_ranges(spark):
    rng = np.random.default_rng(4)
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 7}", int(rng.integers(0, 5000)), float(i) if i % 13 == 0 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t int, v double").repartition(7)
    held = ranges.ranged(df, "k", "t")
    sizes = [r["count"] for r in held.groupBy("_part").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 1500 and held.where("k = 'hot'").select("_part").distinct().count() > 1  # two thirds of all rows are one key
    got = ranges.numbered(df, ["k"], ["t"]).collect()
    for k in {r[0] for r in rows}:
        own = sorted((r for r in got if r["k"] == k), key=lambda r: r["_n"])
        assert [r["_n"] for r in own] == list(range(1, len(own) + 1)) and {r["_total"] for r in own} == {len(own)} and [r["t"] for r in own] == sorted(r["t"] for r in own)
    unique = spark.createDataFrame([(k, i, v) for i, (k, _, v) in enumerate(rows)], "k string, t int, v double").repartition(7)
    last = {}
    for r in sorted(ranges.carried(unique, ["k"], ["t"], "v").collect(), key=lambda r: r["t"]):
        last[r["k"]] = r["v"] if r["v"] is not None else last.get(r["k"])
        assert r["_last"] == last[r["k"]]


def test_asof_splits_an_asset_that_has_most_rows(spark):
    prices = spark.createDataFrame([("hot" if i % 10 else "cold", DAYS[i % 700], i) for i in range(2100)], "asset string, date date, price int")
    slow = spark.createDataFrame([(a, DAYS[d], None if d == 300 else float(d)) for a in ("hot", "cold", "none") for d in range(5, 700, 59)], "asset string, date date, x double")
    want = lambda d: max((s for s in range(5, 700, 59) if s <= d), default=None)
    for r in panel.asof_attach(prices, slow, "x").collect():
        d = want((r["date"] - DAYS[0]).days)
        assert r["x"] == (None if d in (None, 300) else float(d))
    assert panel.asof_attach(prices, slow.limit(0), "x").where("x is not null").count() == 0


@pytest.mark.parametrize("k", [1, 3, 5, 40])
def test_buckets_are_those_of_ntile(spark, k):
    from pyspark.sql import Window

    rng = np.random.default_rng(k)
    df = spark.createDataFrame([(f"a{i}", DAYS[int(rng.integers(0, 6))], float(rng.integers(0, 20)), 1.0 * i) for i in range(150)], "asset string, date date, size double, ret double")
    want = df.withColumn("bucket", F.ntile(k).over(Window.partitionBy("date").orderBy("size", "asset"))).groupBy("date", "bucket").agg(F.count("*"), F.avg("ret")).collect()
    got = panel.sorted_portfolios(df, "size", k)
    assert sorted((r[0], r[1], r[2], round(r[3], 9)) for r in got.collect()) == sorted((r[0], r[1], r[2], round(r[3], 9)) for r in want)


@pytest.mark.parametrize("bins", [64, 1024])
def test_order_statistics_close_in_on_exact_values(spark, bins):
    rng = np.random.default_rng(8)
    groups = {"a": rng.normal(size=500), "b": np.round(rng.normal(size=400), 1), "c": np.array([3.0]), "d": np.full(50, -7.5), "e": np.array([1e300, -1e300, 1e-300, 0.0, 5.0, 1e10]), None: rng.exponential(size=90) ** 9}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("b", float("nan")), ("gone", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    sizes = df.where("v is not null and not isnan(v)").groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    wanted = sizes.select("k", "low", "high", F.explode(F.array(F.lit(1).cast("long"), F.floor(F.col("n") / 3) + 1, "n")).alias("rank")).distinct()
    for r in selection.order_statistics(df.where("v is not null and not isnan(v)"), ["k"], "v", wanted, bins).collect():
        assert r["value"] == np.sort(groups[r["k"]])[r["rank"] - 1]
    if bins > 64:
        got = {r["k"]: r for r in selection.quantiles(df, ["k"], "v", {"lo": 0.1, "hi": 0.95}).collect()}
        assert set(got) == set(groups)
        for k, vs in groups.items():
            assert np.isclose(got[k]["lo"], np.quantile(vs, 0.1)) and np.isclose(got[k]["hi"], np.quantile(vs, 0.95))


def test_winsorize_keeps_null_rows_and_columns(spark):
    df = spark.createDataFrame([("a", DAYS[0], 1.0, "x"), ("b", DAYS[0], None, "y"), ("c", DAYS[0], 9.0, "z"), ("d", DAYS[1], None, "w")], "asset string, date date, ret double, note string")
    got = {r["asset"]: r for r in panel.winsorize(df, "ret", 0.25, 0.75).collect()}
    assert {k: r["ret"] for k, r in got.items()} == {"a": 3.0, "b": None, "c": 7.0, "d": None} and got["b"]["note"] == "y"


def test_factors_with_large_means_are_solved_as_lstsq_does(spark):
    rng = np.random.default_rng(5)
    f = rng.normal(size=(200, 2)) + [0, 1e6]
    y = 0.5 + f @ [1.5, -2.0] + rng.normal(size=200)
    rets = spark.createDataFrame([("a", d, float(v)) for d, v in zip(DAYS, y)], source.RETURNS)
    factors = spark.createDataFrame([(d, n, float(v)) for d, row in zip(DAYS, f) for n, v in zip("xy", row)], source.FACTORS)
    got = regression.ols(rets, factors, ["x", "y"]).first()
    want = np.linalg.lstsq(np.column_stack([np.ones(200), f - [0, 1e6]]), y, rcond=None)[0]
    assert np.allclose([got["beta_x"], got["beta_y"]], want[1:], rtol=1e-8) and np.isclose(got["alpha"] + 1e6 * got["beta_y"], want[0], rtol=1e-6)
    assert regression.ols(rets, factors.where("factor = 'x'").unionByName(factors.where("factor = 'y'").withColumn("value", F.lit(3.0))), ["x", "y"]).first()["beta_x"] is None


def test_pivoted_cholesky_solves_and_sees_collinear_columns():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 30, 4))
    x[7, :, 2] = x[7, :, 0] - x[7, :, 3]
    x[9, :, 1] = 0
    a = np.einsum("nti,ntj->nij", x, x)
    scale = np.sqrt(np.maximum(np.einsum("nii->ni", a), 1e-300))
    unit, b = a / scale[:, :, None] / scale[:, None, :], rng.normal(size=(50, 4))
    got, fine = solve.pivoted_cholesky(unit, b)
    assert set(np.flatnonzero(~fine)) == {7, 9}
    assert np.allclose(got[fine], np.linalg.solve(unit[fine], b[fine][:, :, None])[:, :, 0])


@pytest.mark.parametrize("width", [1, 2, 24, 500])
def test_rolling_fits_equal_numpy_on_every_frame(spark, width):
    rng = np.random.default_rng(7)
    f = rng.normal(size=(620, 2)) + [100, 0]
    y = f @ [1.0, 2.0] + rng.normal(size=620)
    rets = spark.createDataFrame([("a", d, None if i == 300 else float(v)) for i, (d, v) in enumerate(zip(DAYS, y))] + [("b", DAYS[3], 1.0)], source.RETURNS)
    factors = spark.createDataFrame([(d, n, float(v)) for d, row in zip(DAYS, f) for n, v in zip("xy", row)], source.FACTORS)
    got = [r for r in regression.rolling_ols(rets, factors, ["x", "y"], width).orderBy("asset", "date").collect() if r["asset"] == "a"]
    held = np.delete(np.arange(620), 300)
    for k in range(0, 619, 7):
        at = held[max(0, k - width + 1) : k + 1]
        if len(at) < width or width < 3:
            assert got[k]["beta_x"] is None and got[k]["n"] == len(at)
        else:
            want = np.linalg.lstsq(np.column_stack([np.ones(len(at)), f[at]]), y[at], rcond=None)[0]
            assert np.allclose([got[k]["alpha"], got[k]["beta_x"], got[k]["beta_y"]], want, rtol=1e-7, atol=1e-7)
    beta = [r["beta"] for r in regression.rolling_beta(rets, factors.where("factor = 'x'"), width).where("asset = 'a'").orderBy("date").collect()]
    for k in range(0, 620, 9):
        at = np.arange(max(0, k - width + 1), k + 1)
        full = len(at) == width and 300 not in at and width > 1
        assert np.isclose(beta[k], np.polyfit(f[at, 0], y[at], 1)[0]) if full else beta[k] is None


def test_newey_west_and_gaps_have_no_window_without_a_key(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=90).cumsum()
    series = spark.createDataFrame([(d, float(x)) for d, x in zip(DAYS, v)] + [(DAYS[200], None)], "date date, v double").repartition(5)
    got = regression.newey_west(series, "v", 3).first()
    e = v - v.mean()
    long = e @ e + 2 * sum((1 - k / 4) * (e[k:] @ e[:-k]) for k in (1, 2, 3))
    assert got["n"] == 90 and np.isclose(got["mean"], v.mean()) and np.isclose(got["variance"], long / 90**2) and np.isclose(got["t"], v.mean() / np.sqrt(long / 90**2))
    assert regression.newey_west(series.limit(0), "v", 3).collect() == []


def test_upsert_rewrites_only_the_years_it_touches(spark, tmp_path):
    path = str(tmp_path / "p")
    day = lambda y: dt.date(y, 5, 1)
    rows = lambda *r: spark.createDataFrame(r, "asset string, date date, v double, version int")
    source.upsert_panel(rows(("a", day(2000), 1.0, 1), ("a", day(2001), 2.0, 5), ("b", None, 0.5, 1)), path, ["asset", "date"], "version")
    files = lambda y: {f.name for f in (tmp_path / "p" / f"year={y}").glob("*.parquet")}
    before = files(2000)
    source.upsert_panel(rows(("a", day(2001), 9.0, 4), ("b", day(2001), 3.0, 1), ("c", day(2002), 4.0, 1), ("b", None, 0.7, 2)), path, ["asset", "date"], "version")
    source.upsert_panel(rows(("b", day(2001), 6.0, 2)), path, ["asset", "date"], "version")
    got = {(r["asset"], r["year"]): (r["v"], r["version"]) for r in spark.read.parquet(path).collect()}
    assert got == {("a", 2000): (1.0, 1), ("a", 2001): (2.0, 5), ("b", 2001): (6.0, 2), ("c", 2002): (4.0, 1), ("b", None): (0.7, 2)} and files(2000) == before
    bad = rows(("a", day(2000), 1.0, 9)).withColumn("v", F.raise_error(F.lit("broken")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        source.upsert_panel(bad, path, ["asset", "date"], "version")
    assert {(r["asset"], r["year"]): (r["v"], r["version"]) for r in spark.read.parquet(path).collect()} == got


def test_every_tick_is_in_one_bar_or_late(spark, tmp_path):
    rng = np.random.default_rng(10)
    begin = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    schema = "asset string, ts timestamp, seq long, price double"
    all_ticks, kept = 0, []
    for part in range(4):
        ticks = [(f"a{int(rng.integers(0, 3))}", begin + dt.timedelta(minutes=int(m)), part * 1000 + i, float(i)) for i, m in enumerate(rng.integers(0, 200 * (part + 1), 150))]
        if part == 2:
            ticks.append(("a0", None, 9999, 1.0))
        spark.createDataFrame(ticks, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        all_ticks += 150
        final, open_, missed = late.run_late_bars(spark, str(tmp_path / "in"), "*.parquet", spark.createDataFrame([], schema).schema, lambda d: d, str(tmp_path / "out"), str(tmp_path / "state"), "10 minutes", "30 minutes")
        counts = [d.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for d in (final, open_)] + [missed.count()]
        kept.append(counts)
        assert sum(counts) == all_ticks
        assert final.count() == final.select("asset", "start").distinct().count()
    assert kept[-1][2] > 0 and kept[-1][0] > kept[0][0]
    again = late.run_late_bars(spark, str(tmp_path / "in"), "*.parquet", spark.createDataFrame([], schema).schema, lambda d: d, str(tmp_path / "out"), str(tmp_path / "state"), "10 minutes", "30 minutes")
    assert [again[0].count(), again[1].count(), again[2].count()] == [final.count(), open_.count(), missed.count()]
