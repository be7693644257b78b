"""Each query of the factor library against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from factorweave.jobs import queries as Q

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "none"
    return f"{v:.5f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, duck, name):
    got = Q.QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    sql = duck.sql(Q.SQL[name])
    assert sorted(sql.columns) == columns
    at = [sql.columns.index(c) for c in columns]
    one = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    other = sorted(tuple(plain(r[i]) for i in at) for r in sql.fetchall())
    assert one == other


def test_pca_explains_the_variance_that_numpy_finds(spark):
    import numpy as np

    from factorweave.jobs import stand_in

    rets = stand_in.monthly_returns(spark, "/root/testdata/sf0.01").cache()
    from factorweave.operators.risk import pca_factors

    assets = sorted({r["asset"] for r in rets.collect()})[:5]
    found = pca_factors(rets, assets, 2).toPandas()
    wide = rets.toPandas().pivot(index="date", columns="asset", values="ret")[assets].dropna()
    values = np.sort(np.linalg.eigvalsh(np.cov(wide.to_numpy().T)))[::-1]
    assert np.allclose(sorted(set(found["share"].round(9)), reverse=True), values[:2] / values.sum(), atol=1e-6)
    assert np.allclose(found.groupby("component")["loading"].apply(lambda x: (x**2).sum()), 1)


def test_pca_query_takes_all_assets(spark):
    from factorweave.jobs import stand_in

    rets = stand_in.monthly_returns(spark, DIR)
    assets = {r["asset"] for r in rets.select("asset").distinct().collect()}
    found = Q.QUERIES["p30_pca_factors"](spark, DIR).collect()
    assert len(assets) == 25 and {(r["component"], r["asset"]) for r in found} == {(c, a) for c in (1, 2, 3) for a in assets}


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
