"""Known answers and edge cases of the factor library."""

import datetime as dt

import numpy as np
import pytest

from factorweave.operators import panel, regression, risk
from factorweave.sources import panel as source

DAYS = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(40)]


@pytest.fixture(scope="module")
def made(spark):
    """Returns made of two factors with known betas and no noise, and one asset with a single date."""
    rng = np.random.default_rng(1)
    f = rng.normal(size=(40, 2))
    betas = {"a": (0.5, -1.0), "b": (2.0, 0.25)}
    rows = [(k, d, float(0.01 + b[0] * x[0] + b[1] * x[1])) for k, b in betas.items() for d, x in zip(DAYS, f)] + [("c", DAYS[0], 0.1)]
    rets = spark.createDataFrame(rows, source.RETURNS)
    factors = spark.createDataFrame([(d, n, float(v)) for d, x in zip(DAYS, f) for n, v in zip("xy", x)], source.FACTORS)
    return rets, factors, betas


def test_ols_recovers_betas_and_leaves_nothing(made):
    rets, factors, betas = made
    fit = regression.ols(rets, factors, ["x", "y"])
    got = {r["asset"]: r for r in fit.collect()}
    for k, b in betas.items():
        assert np.allclose([got[k]["alpha"], got[k]["beta_x"], got[k]["beta_y"]], [0.01, *b])
    assert got["c"]["n"] == 1 and got["c"]["beta_x"] is None
    left = regression.residuals(rets, factors, fit, ["x", "y"]).where("asset <> 'c'")
    assert max(abs(r["residual"]) for r in left.collect()) < 1e-9


def test_collinear_factors_have_no_solution(made):
    rets, factors, _ = made
    same = factors.where("factor = 'x'").selectExpr("date", "'z' as factor", "value * 2 as value")
    assert all(r["beta_x"] is None for r in regression.ols(rets, factors.unionByName(same), ["x", "z"]).collect())


def test_rolling_fit_is_null_until_full(made):
    rets, factors, betas = made
    rows = regression.rolling_ols(rets, factors, ["x", "y"], 10).where("asset = 'a'").orderBy("date").collect()
    assert all(r["beta_x"] is None for r in rows[:9]) and np.allclose([r["beta_x"] for r in rows[9:]], betas["a"][0])


def test_attribution_and_residual_add_up(made):
    rets, factors, _ = made
    fit = regression.ols(rets, factors, ["x", "y"]).where("asset <> 'c'")
    parts = risk.attribution(risk.exposures_long(fit, ["x", "y"]), factors).groupBy("asset", "date").sum("contribution")
    both = rets.join(parts, ["asset", "date"]).join(fit.select("asset", "alpha"), "asset").collect()
    assert len(both) == 80 and all(abs(r["ret"] - r["alpha"] - r["sum(contribution)"]) < 1e-9 for r in both)


def test_gap_gives_null_return(spark):
    prices = spark.createDataFrame([("a", DAYS[0], 1.0, 1.0), ("a", DAYS[1], 2.0, 1.0), ("a", DAYS[9], 4.0, 1.0)], source.PRICES)
    from pyspark.sql import functions as F

    assert [r["ret"] for r in panel.returns(prices, "simple", F.lit(1)).orderBy("date").collect()] == [1.0, None]
    assert [r["ret"] for r in panel.returns(prices).orderBy("date").collect()] == [1.0, 1.0]


def test_missing_cells_of_empty_and_full_panels(spark):
    full = spark.createDataFrame([(a, d, 0.0) for a in "ab" for d in DAYS[:3]], source.RETURNS)
    assert panel.missing_cells(full, full).count() == 0
    assert panel.missing_cells(full.where(f"asset = 'a' or date = '{DAYS[1]}'"), full).count() == 2
    assert panel.missing_cells(full.limit(0), full).count() == 0


def test_constant_cross_section_has_no_zscore(spark):
    flat = spark.createDataFrame([(a, DAYS[0], 1.0) for a in "abc"], source.RETURNS)
    assert {r["z"] for r in panel.zscore(flat, "ret").collect()} == {None}


def test_panel_round_trip_and_revisions(spark, tmp_path, made):
    rets = made[0]
    source.write_panel(rets, str(tmp_path / "p"))
    assert source.read_panel(spark, str(tmp_path / "p"), source.RETURNS).count() == rets.count()
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, None)], "k string, v int, w string")
    assert sorted((r["k"], r["w"]) for r in source.latest_revision(rows, ["k"], "v").collect()) == [("a", "z"), ("b", None)]


def test_rows_after_null_and_zero_prices_have_null_returns(spark):
    prices = spark.createDataFrame([("a", DAYS[i], p, 1.0) for i, p in enumerate([None, 1.0, 2.0, None, 3.0, 0.0, 1.0])], source.PRICES)
    assert [r["ret"] for r in panel.returns(prices).orderBy("date").collect()] == [None, 1.0, None, None, -1.0, None]


def test_momentum_after_a_total_loss(spark):
    rets = spark.createDataFrame([("a", DAYS[i], r) for i, r in enumerate([0.1, -1.0, 0.1, 0.1, 0.1, -1.5, 0.1, 0.1])], source.RETURNS)
    got = [r["mom"] for r in panel.momentum(rets, 3, 1).orderBy("date").collect()]
    assert got[:3] == [None] * 3 and got[3:5] == [-1.0, -1.0] and np.allclose(got[5:], [1.1**3 - 1, -0.5 * 1.1**2 - 1, -0.5 * 1.1**2 - 1])


def test_covariance_blocks_make_the_whole_matrix(made):
    from pyspark.sql import functions as F

    rets = made[0].where("asset <> 'c'")
    whole = {(r["f1"], r["f2"]): r["cov"] for r in risk.covariance(rets, "asset", "ret").collect()}
    one, other = (rets.select("asset").where(F.col("asset") == x) for x in "ab")
    assert np.isclose(risk.covariance_block(rets, one, other).first()["cov"], whole["a", "b"])
    assert np.isclose(risk.covariance_block(rets, other, other).first()["cov"], whole["b", "b"])


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from factorweave.sources import shared

    cluster = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(cluster)
