"""Least squares in columns against numpy."""

import numpy as np
import pytest
from conftest import walk
from pyspark.sql import functions as F

from barloom.functions import linear
from barloom.functions import statistics as S


@pytest.fixture(scope="module")
def series():
    return {"A": np.log(walk(300, 1)["close"].to_numpy()), "B": np.sin(np.arange(180) / 5) + 0.1 * np.random.default_rng(2).normal(size=180)}


@pytest.fixture(scope="module")
def table(spark, series):
    return spark.createDataFrame([(t, k, float(v)) for t, x in series.items() for k, v in enumerate(x)], "ticker string, k long, x double")


def test_gram_and_sweeps(spark):
    x = np.random.default_rng(1).normal(size=(50, 3))
    x = np.column_stack([np.ones(50), x[:, :2], x[:, 0] + x[:, 1], x[:, 2]])  # the fourth column is explained by two before it
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, a double, b double, c double, d double, y double")
    g = linear.gram(df, ["g"], [F.col(c) for c in "abcdy"])
    row = g.select("n", "gram", linear.left_over(F.col("gram"), 5).alias("left"), linear.swept_all(F.col("gram"), F.lit(3), 5).alias("m")).first()
    np.testing.assert_allclose(np.array(row["gram"]).reshape(5, 5), x.T @ x)
    y = x[:, 4]
    want = [y @ y] + [((y - x[:, :k] @ np.linalg.lstsq(x[:, :k], y, rcond=None)[0]) ** 2).sum() for k in range(1, 5)]
    np.testing.assert_allclose(row["left"], want, rtol=1e-9)
    np.testing.assert_allclose(np.array(row["m"]).reshape(5, 5)[4, :3], np.linalg.lstsq(x[:, :3], y, rcond=None)[0], rtol=1e-9)
    assert row["n"] == 50


def test_unit_root_in_columns(table, series):
    got = {r["ticker"]: r for r in S.unit_root(table, "x", ["ticker"], "k", most=6).collect()}
    for t, x in series.items():
        want = S.unit_root_value(x, most=6)
        assert (got[t]["lags"], got[t]["observations"], got[t]["stationary"]) == (want["lags"], want["observations"], want["stationary"])
        assert got[t]["statistic"] == pytest.approx(want["statistic"], rel=1e-6) and got[t]["critical"] == pytest.approx(want["critical"])
    with pytest.raises(ValueError, match="level"):
        S.unit_root(table, "x", ["ticker"], "k", level=0.02)


def test_arch_lm_in_columns(table, series):
    moved = table.withColumn("r", F.col("x") - F.lag("x").over(S.Window.partitionBy("ticker").orderBy("k")))
    got = {r["ticker"]: r for r in S.arch_lm(moved, "r", ["ticker"], "k", 3).collect()}
    for t, x in series.items():
        lm, p = S.arch_lm_value(np.diff(x), 3)
        assert got[t]["lm"] == pytest.approx(lm, rel=1e-8) and got[t]["p_value"] == pytest.approx(p, rel=1e-6) and got[t]["n"] == len(x) - 4
