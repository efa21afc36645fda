import json
import math
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from conftest import walk
from pyspark.sql import functions as F

from barloom import queries
from barloom.functions import statistics as S
from barloom.functions.windows import ewm
from barloom.models import numeric, returns
from barloom.operators import clean, evaluate, forecasts, fundamentals, indicators
from barloom.plans import walkforward
from barloom.settings import load_settings, resolve_path
from barloom.sources import files

SETTINGS = load_settings()


def test_settings(tmp_path):
    (tmp_path / "s.yaml").write_text("forecast: {horizon_days: 3}\n")
    s = load_settings(tmp_path / "s.yaml", market={"round_trip_cost": 0})
    assert s["forecast"]["horizon_days"] == 3 and s["forecast"]["random_seed"] == 42 and s["market"]["round_trip_cost"] == 0
    assert resolve_path("/a/b") == resolve_path("b", "/a")


@pytest.mark.parametrize("alpha", [0.2, 1 / 14, 2 / 27, 1 / 50, 2 / 201, 0.001, 0.6, 0.97, 1.0])
def test_ewm_equals_pandas_over_block_borders(spark, alpha):
    x = np.random.default_rng(3).normal(5, 1, 2600)
    pdf = pd.DataFrame({"ticker": "T", "date": pd.bdate_range("2010-01-01", periods=2600).date, "x": x})
    pdf.loc[:2, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = ewm(df, F.col("x"), alpha, "y", 10).orderBy("date").toPandas()["y"].astype(float)
    want = pdf["x"].ewm(alpha=alpha, adjust=False, min_periods=10).mean()
    assert got.isna().equals(want.isna())
    np.testing.assert_allclose(got.dropna(), want.dropna(), rtol=1e-12)


def test_indicators_do_not_look_ahead(spark, bars):
    whole = indicators.compute_all(bars, SETTINGS).orderBy("ticker", "date").toPandas()
    cut_date = sorted(whole["date"].unique())[420]
    part = indicators.compute_all(bars.where(F.col("date") <= F.lit(cut_date)), SETTINGS).orderBy("ticker", "date").toPandas()
    old = whole[whole["date"] <= cut_date].reset_index(drop=True)
    for name in indicators.REGISTRY:
        np.testing.assert_allclose(part[name].astype(float), old[name].astype(float), rtol=1e-9, atol=1e-12, equal_nan=True)
        values = whole[name].dropna().astype(float)
        assert len(values) > 900 and values.between(-1, 1).all()


def test_trends_have_the_right_sign(spark):
    up = walk(300, 5, "UP")
    up["close"] = 100 * np.exp(0.01 * np.arange(300))
    up["open"] = up["close"].shift().fillna(up["close"][0])
    up["high"], up["low"], up["volume"] = up[["open", "close"]].max(axis=1) * 1.001, up[["open", "close"]].min(axis=1) * 0.999, 1e6
    last = indicators.compute_all(spark.createDataFrame(up), SETTINGS).orderBy(F.desc("date")).first()
    assert last["rsi"] == 1.0 and last["directional_movement"] > 0.5 and last["adx_raw"] > 50 and last["moving_average_spread"] > 0


def test_cleaning(spark):
    raw = walk(30, 4)
    raw.loc[3, "high"] = max(raw.loc[3, "open"], raw.loc[3, "close"]) * 0.999
    raw.loc[5, "volume"] = np.nan
    flat = raw.iloc[[10]].copy()
    flat[["open", "high", "low"]] = flat["close"].iloc[0]
    flat["volume"], flat["date"] = 0.0, datetime(2020, 1, 1).date()
    raw = pd.concat([raw, flat, raw.iloc[[7]].assign(close=lambda d: d["close"] * 1.0001)], ignore_index=True)
    raw["ingest_seq"] = range(len(raw))
    df = spark.createDataFrame(raw.rename(columns={"close": "Close", "date": "DATE"}))
    out = clean.drop_placeholders(clean.standardise(df, 0.005))
    assert out.count() == 29
    assert out.where("high < greatest(open, close) OR low > least(open, close)").count() == 0
    clean.validate(out)
    with pytest.raises(clean.InvalidBars):
        clean.standardise(df.withColumn("high", F.col("high") * 0.9), 0.005)
    with pytest.raises(clean.InvalidBars):
        clean.renamed(df.drop("volume"))
    with pytest.raises(clean.InsufficientHistory):
        clean.ensure_history(out.where("date < '2019-01-01'"), 3)
    local = clean.drop_unfinished(spark.createDataFrame([("T", datetime(2024, 1, 2).date()), ("T", datetime(2024, 1, 3).date())], "ticker string, date date"), datetime(2024, 1, 2, 20, 0), "Asia/Kolkata")
    assert [r["date"].day for r in local.collect()] == [2]


def test_redundancy():
    """Two chains of near copies and a loner: each chain keeps the member that stands first."""
    rho = np.eye(5)
    for i, j, r in ((0, 2, -0.93), (2, 4, 0.88), (1, 3, 0.81)):
        rho[i, j] = rho[j, i] = r
    kept, dropped = indicators.prune(["macd", "cci", "rsi", "obv_slope", "stochastic"], rho, 0.8)
    assert kept == ["macd", "cci", "stochastic"] and {n: d[0] for n, d in dropped.items()} == {"rsi": "macd", "obv_slope": "cci"}


def test_garch_path_equals_the_recursion(spark):
    x = np.cumsum(np.random.default_rng(5).standard_t(4, 3001) / 100)
    df = spark.createDataFrame(pd.DataFrame({"ticker": "T", "date": pd.bdate_range("2005-01-03", periods=3001).date, "close": 100 * np.exp(x)}))
    for omega, alpha, gamma, beta in ((0.0005, 0.0003, 0.0004, 0.999), (0.05, 0.06, 0.08, 0.85), (0.2, 0.3, 0.1, 0.2)):
        got = forecasts.garch_path(forecasts.log_returns(df), omega, alpha, gamma, beta).orderBy("date").toPandas()["variance"]
        e = 100 * (np.diff(x) - np.diff(x).mean())
        v, want = omega / (1 - alpha - gamma / 2 - beta), []
        for s in e:
            v = omega + (alpha + gamma * (s < 0)) * s * s + beta * v
            want.append(v)
        np.testing.assert_allclose(got, want, rtol=1e-9)


def test_trend_filter_equals_the_textbook_filter():
    rng = np.random.default_rng(11)
    y = 4 + np.cumsum(rng.normal(0, 0.01, 400)) + rng.normal(0, 0.005, 400)
    observation, slope = 0.4, 0.002
    a, p, move, noise = np.array([y[0], 0.0]), np.diag([1e4, 1e4]), np.array([[1.0, 1], [0, 1]]), np.diag([1.0, slope])
    e, f, tilt, spread = [], [], [], []
    for t in range(400):
        if t:
            a, p = move @ a, move @ p @ move.T + noise
        v = p[0, 0] + observation
        gain = p[:, 0] / v
        e.append(y[t] - a[0])
        f.append(v)
        a, p = a + gain * e[-1], p - np.outer(gain, p[0])
        tilt.append(a[1])
        spread.append(p[1, 1])
    got = returns.Trend.run(y, observation, slope, True)
    for mine, want in zip(got, (e, f, tilt, spread), strict=True):
        np.testing.assert_allclose(mine[2:], want[2:], rtol=1e-6, atol=1e-9)
    fit = returns.Trend.fit(y)
    assert fit.converged and fit.level_variance > 0
    z = returns.Trend(1e-4, observation, slope, True).slope_z(y)
    np.testing.assert_allclose(z[2:], (np.array(tilt) / np.sqrt(np.array(spread) * 1e-4))[2:], rtol=1e-6)


def test_gradients_of_the_likelihoods():
    rng = np.random.default_rng(1)
    e = rng.standard_t(5, 300)
    for f, p in ((lambda q: returns.Garch.surprise(e, 1.5, q), [0.05, 0.04, 0.08, 0.88, 6.0]), (lambda q: returns.Merton.surprise(e, q, 8), [0.03, 0.8, 0.05, -0.2, 4.0])):
        p = np.array(p)
        by = [(f(p + d)[0] - f(p - d)[0]) / 2e-6 for d in 1e-6 * np.eye(5)]
        np.testing.assert_allclose(f(p)[1], by, rtol=1e-4, atol=1e-4)
    g = returns.Garch(0.0, 0.05, 0.04, 0.08, 0.88, 6.0, 0, 0, True)
    np.testing.assert_allclose(returns.Garch.natural(g.free(1.3, True), 1.3), [0.05, 0.04, 0.08, 0.88, 6.0], rtol=1e-9)


def test_fits_are_the_likeliest_that_a_search_finds():
    """Quasi-Newton fits against Nelder and Mead's search from the true parameters."""
    rng = np.random.default_rng(8)
    e, v = [], 1.0
    for _ in range(1500):
        x = math.sqrt(v) * rng.standard_t(7) * math.sqrt(5 / 7)
        e.append(x)
        v = 0.04 + (0.05 + 0.06 * (x < 0)) * x * x + 0.88 * v
    prices = np.cumsum([4.0, *(np.array(e) / 100)])
    r = 100 * np.diff(prices)
    garch, merton = returns.Garch.fit(prices), returns.Merton.fit(prices)
    c = r - r.mean()
    searched = numeric.simplex(lambda p: returns.Garch.surprise(c, c.var(), p)[0] if p.min() > 0 and p[1] + p[2] / 2 + p[3] < 0.9995 and p[4] > 2.05 else math.inf, np.array([0.04, 0.05, 0.06, 0.88, 7.0]), step=0.02, rounds=3000)
    assert -garch.likelihood <= searched.value + 1e-3 and garch.converged
    searched = numeric.simplex(lambda p: returns.Merton.surprise(r, p, 8)[0] if min(p[1], p[2], p[4]) > 0 and p[2] < 0.5 else math.inf, np.array([0.0, 0.8, 0.1, 0.0, 2.0]), step=0.05, rounds=3000)
    assert -merton.likelihood <= searched.value + 1e-3
    warm = returns.Garch.fit(prices, warm=garch)
    assert warm.likelihood == pytest.approx(garch.likelihood, abs=1e-4)


def test_quantile_edges_equal_pandas(spark):
    pairs = [(n, bins) for n in (1, 2, 7, 76, 101, 389, 1000) for bins in (2, 3, 7, 10)]
    rows = spark.createDataFrame([(n, b, k) for n, b in pairs for k in range(b + 1)], "n long, bins int, k int")
    got = rows.withColumn("edge", evaluate.linear_edge(F.col("n"), F.col("k"), F.col("bins"))).collect()
    for r in got:
        want = pd.Series(np.arange(1, r["n"] + 1)).quantile(r["k"] / r["bins"])
        assert r["edge"] == pytest.approx(want, abs=1e-9)


def test_sector_of_each_ticker(spark):
    b = spark.createDataFrame(pd.concat([walk(300, k, t) for k, t in enumerate("ABC")]))
    index = spark.createDataFrame(walk(320, 9, "I")).select("date", "close")
    sectors = spark.createDataFrame(pd.concat([walk(310, 20 + k, t) for k, t in enumerate("AB")])).select("ticker", "date", "close")
    got = {r["ticker"]: r for r in fundamentals.market_context(b, index, sectors).collect()}
    for k, t in enumerate("AB"):
        alone = fundamentals.market_context(b.where(F.col("ticker") == t), index, sectors.where(F.col("ticker") == t).select("date", "close")).first()
        assert all(got[t][c] == pytest.approx(alone[c]) for c in ("vs_benchmark", "vs_sector", "sector_vs_benchmark", "beta"))
    assert got["C"]["vs_sector"] is None and got["C"]["vs_benchmark"] is not None


def test_reports_of_all_tickers(spark, tmp_path):
    from barloom.plans import live

    s = load_settings(forecast={"monte_carlo_paths": 200}, walk_forward={"min_training_days": 400, "forecast_every_days": 10, "refit_every_days": 60, "min_scored_forecasts_for_model_selection": 3}, models={"hmm": {"max_iterations": 30}}, output={"directory": str(tmp_path)})
    b = spark.createDataFrame(pd.concat([walk(520, 31, "A"), walk(520, 32, "B")]))
    none = lambda n: spark.createDataFrame([], files.FUNDAMENTALS[n])
    index = b.where("ticker = 'A'").select("date", "close")
    a = live.analyse(b, none("earnings"), none("statements"), none("multiples"), spark.createDataFrame([], "ticker string, peer string"), index, None, s)
    done = {r["ticker"]: r for r in live.write_reports(a, s).collect()}
    assert set(done) == {"A", "B"}
    for t, r in done.items():
        assert all(f"{k}. " in r["report"] for k in range(1, 8)) and "no index" not in r["report"]
        short = json.loads(r["summary"])
        assert short["ticker"] == t and short["price_intervals"]["0.5"][0] < short["median_price"] < short["price_intervals"]["0.5"][1]
    assert {p.name for p in tmp_path.iterdir()} == {"report", "summary", "records", "calibration", "forecast"}
    panels = spark.read.csv(str(tmp_path / "calibration"), header=True).select("ticker", "panel").distinct().count()
    assert panels == 6 and a.forecast.count() == 2


def test_distributions():
    assert S.normal_cdf_value(1.959964) == pytest.approx(0.975, abs=1e-6)
    assert S.chi_square_tail_value(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert S.chi_square_tail_value(11.070498, 5) == pytest.approx(0.05, abs=1e-6)
    assert S.chi_square_tail_value(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert S.critical_value(0.05, 1000) == pytest.approx(-2.864, abs=1e-3)


def test_unit_root():
    rng = np.random.default_rng(2)
    walk_, mean = np.cumsum(rng.normal(size=1000)), np.zeros(1000)
    for i in range(1, 1000):
        mean[i] = 0.9 * mean[i - 1] + rng.normal()
    assert S.unit_root_value(mean)["stationary"] and not S.unit_root_value(walk_)["stationary"]


def test_simplex_finds_rosenbrock():
    found = numeric.simplex(lambda p: (1 - p[0]) ** 2 + 100 * (p[1] - p[0] ** 2) ** 2 if p[0] < 3 else math.inf, np.array([-1.2, 1.0]), rounds=4000)
    np.testing.assert_allclose(found.at, [1, 1], atol=1e-3)


def test_recursions_equal_loops():
    rng = np.random.default_rng(0)
    u = rng.normal(size=300)
    y, want = 2.0, []
    for v in u:
        y = v + 0.9 * y
        want.append(y)
    np.testing.assert_allclose(numeric.first_order(u, 0.9, 2.0), want)
    start, move, b = np.array([0.4, 0.6]), np.array([[0.95, 0.05], [0.1, 0.9]]), rng.uniform(0.1, 1, (333, 2))
    filtered, scale = numeric.chain(start, move, b)
    p = start
    for t in range(333):
        joint = p * b[t]
        assert scale[t] == pytest.approx(joint.sum())
        np.testing.assert_allclose(filtered[t], joint / joint.sum())
        p = filtered[t] @ move


def test_parameter_recovery():
    rng = np.random.default_rng(7)
    v, e = 0.05 / (1 - 0.96), []
    for _ in range(6000):
        x = math.sqrt(v) * rng.standard_t(6) * math.sqrt(4 / 6)
        e.append(x / 100)
        v = 0.05 + (0.04 + 0.08 * (x < 0)) * x * x + 0.88 * v
    g = returns.Garch.fit(np.cumsum([4, *e]))
    assert abs(g.persistence - 0.96) < 0.03 and abs(g.nu - 6) < 1.5 and g.gamma > 0.02
    shocks = 100 * (np.array(e) - np.mean(e))
    truth = returns.Garch(g.mean, 0.05, 0.04, 0.08, 0.88, 6.0, 0, 0, True)
    var = truth.variances(shocks, shocks.var())[:-1]
    assert g.likelihood >= len(e) * S.t_constant(6.0) - (3.5 * np.log1p(shocks**2 / var / 4) + 0.5 * np.log(var)).sum()
    state, r = 0, []
    for _ in range(5000):
        state = 1 - state if rng.random() < (0.02, 0.05)[state] else state
        r.append(rng.normal((0.001, -0.001)[state], (0.007, 0.02)[state]))
    h = returns.Regimes.fit(np.cumsum([4, *r]), rng)
    np.testing.assert_allclose(np.sqrt(h.variances), [0.007, 0.02], rtol=0.1)
    m = returns.Merton.fit(np.cumsum([4, *(rng.normal(0.0003, 0.01, 6000) + rng.poisson(0.03, 6000) * rng.normal(-0.02, 0.03, 6000))]))
    assert m.sigma == pytest.approx(0.01, rel=0.08) and 0.01 < m.intensity < 0.08
    x = [4.0]
    for _ in range(4000):
        x.append(0.2 + 0.95 * x[-1] + rng.normal(0, 0.01))
    o = returns.Reverting.fit(np.array(x))
    assert o.persistence == pytest.approx(0.95, abs=0.015) and o.level == pytest.approx(4, abs=0.05)
    s = returns.Suite.fit(np.array(x[:800]), 2.0, SETTINGS, rng)
    assert returns.Suite.from_json(s.to_json()) == s and set(s.candidates()) >= {"garch_t_earnings", "ornstein_uhlenbeck"}


def test_drift_learns_and_ignores_unknown_outcomes():
    rng = np.random.default_rng(4)
    n = 3000
    signal = rng.normal(size=n)
    forward = 0.002 + 0.01 * signal + rng.normal(0, 0.02, n)
    kw = {"horizon": 5, "prior_mean": 0.002, "prior_sd": 0.004, "effect_sd": 0.0025}
    evidence = np.column_stack([signal, np.full(n, np.nan)])
    a = returns.drift_posterior(evidence, ["s", "none"], forward, n - 1, **kw)
    poisoned = forward.copy()
    poisoned[n - 5 :] = 1e6
    assert returns.drift_posterior(evidence, ["s", "none"], poisoned, n - 1, **kw) == a
    assert a.coefficients["s"][0] == pytest.approx(0.0093, abs=0.002)
    few = returns.drift_posterior(evidence[:60], ["s", "none"], forward[:60], 59, **kw)
    assert few.mean == 0.002 and few.sd == 0.004


def test_scores(spark):
    df = spark.createDataFrame([("T", "2020-01-01", 1, "m", v, 0.5) for v in (-1.0, 1.0, 2.0, 3.0)], "ticker string, date string, position int, model string, value double, realized double")
    r = evaluate.score(df, [0.5]).first()
    assert r["p_up"] == 0.75 and r["brier"] == 0.0625 and r["pit"] == 0.25
    x = np.array([-1.0, 1, 2, 3])
    assert r["crps"] == pytest.approx(np.abs(x - 0.5).mean() - np.abs(x[:, None] - x).mean() / 2)
    assert walkforward.score_samples(x, 0.5, [0.5])["crps"] == pytest.approx(r["crps"])


def test_walk_forward_is_blind_to_later_bars(spark):
    s = load_settings(forecast={"monte_carlo_paths": 200}, walk_forward={"min_training_days": 400, "forecast_every_days": 10, "refit_every_days": 40, "min_scored_forecasts_for_model_selection": 3}, models={"hmm": {"max_iterations": 40, "random_restarts": 1}, "garch": {"max_iterations": 300}, "merton": {"max_iterations": 300}})
    b = walk(520, 9)
    noisy = b.copy()
    noisy.loc[480:, ["open", "high", "low", "close"]] *= 1.3
    none = spark.createDataFrame([], files.EARNINGS)

    def run(pdf):
        prepared = walkforward.prepare(spark.createDataFrame(pdf), none, s)
        return walkforward.walk_forward(prepared, s)[0].toPandas().sort_values(["position", "model"])

    one, two = run(b), run(noisy)
    assert set(one["model"]) >= {"gbm", "garch_t", "merton_jump", "regime_switching", "engine"}
    early = one["position"] + 5 < 480
    pd.testing.assert_frame_equal(one[early].reset_index(drop=True), two[two["position"] + 5 < 480].reset_index(drop=True))


def test_registered_plan_has_the_full_settings(spark):
    assert queries.PLAN == load_settings()
    days = spark.createDataFrame([(t, k) for t, n in (("A", 700), ("B", 510), ("C", 509)) for k in range(n)], "ticker string, position int")
    got = {(r["ticker"], r["refit"]): r["positions"] for r in walkforward.test_origins(days, queries.PLAN).collect()}
    assert sorted(p for (t, _), of in got.items() for p in of if t == "A") == list(range(504, 695, 5)) and got["A", 1][0] == 529
    assert got["B", 0] == [504] and not any(t == "C" for t, _ in got)


def test_full_samples_follow_the_settings(spark):
    few = queries.full_samples(spark, "/root/testdata/sf0.001").where("position < 515 AND model IN ('gbm', 'engine')")
    values = few.toPandas()
    assert sorted(values["position"].unique()) == [504, 509, 514]
    assert (values.groupby(["ticker", "position", "model"]).size() == 10000).all() and values["ticker"].nunique() == 6
    got = evaluate.score(few, [0.95]).toPandas().set_index(["ticker", "position", "model"])
    for key, g in values.groupby(["ticker", "position", "model"]):
        v, x = g["value"].to_numpy(), g["realized"].iloc[0]
        low, high = np.quantile(v, [0.025, 0.975])
        assert got["hit_95"][key] == (low <= x <= high)
        assert got["crps"][key] == pytest.approx(np.abs(v - x).mean() - np.mean([np.abs(v - y).mean() for y in v]) / 2)


def test_fundamentals(spark):
    ann = [("T", (pd.Timestamp("2020-01-10") + pd.DateOffset(months=3 * i)).to_pydatetime(), 1.0, 1.0 + 0.1 * i, 10.0) for i in range(8)]
    e = spark.createDataFrame(ann, files.EARNINGS)
    b = spark.createDataFrame(walk(700, 3).assign(date=pd.bdate_range("2020-01-01", periods=700).date))
    pe = fundamentals.trailing_pe(b, e, "Asia/Kolkata").toPandas()
    assert str(pe["date"].min()) == "2020-10-12"
    score = fundamentals.surprise_score(e, 5.0).first()
    assert score["score"] == pytest.approx(0.5 + 0.5 * math.tanh(2))
    parts = spark.createDataFrame([("T", "growth", 0.5), ("T", "earnings_surprise", None), ("U", "growth", None)], "ticker string, component string, score double")
    got = {r["ticker"]: r for r in fundamentals.fair_value(parts, SETTINGS["fundamentals"]).collect()}
    assert got["T"]["label"] == "undervalued" and got["U"]["label"] == "not assessable" and got["U"]["annual_drift_tilt"] == 0


def test_cache_round_trip(spark, tmp_path, bars):
    kw = {"start": datetime(2015, 1, 1), "options": {"interval": "1d"}, "now": datetime(2018, 1, 1)}
    calls = []
    fetch = lambda: calls.append(1) or bars
    for _ in range(2):
        got = files.cached(spark, fetch, str(tmp_path), "x", max_age_hours=12, **kw)
    assert len(calls) == 1 and got.count() == bars.count()
    files.cached(spark, fetch, str(tmp_path), "x", max_age_hours=12, **(kw | {"options": {"interval": "1w"}}))
    assert len(calls) == 2
    assert files.safe_name("M&M.NS") == "M_M.NS_1d"
    bars.where("ticker = 'A'").drop("ticker").withColumnRenamed("close", "Close").coalesce(1).write.csv(str(tmp_path / "c"), header=True)
    part = next((tmp_path / "c").glob("*.csv"))
    (tmp_path / "csv").mkdir()
    part.rename(tmp_path / "csv" / "A.csv")
    assert clean.standardise(files.read_csv(spark, str(tmp_path / "csv")), 0.01).select("ticker").distinct().collect()[0][0] == "A"
    assert files.read_fundamentals(spark, str(tmp_path))["earnings"].count() == 0


def test_streaming_bars_equal_batch(spark, tmp_path):
    from barloom.streaming.bars import intraday_bars

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = intraday_bars(stream, late="60 days").writeStream.format("memory").queryName("bars_out").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    last = spark.sql("SELECT ticker, bar_start, max(volume) AS v FROM bars_out GROUP BY 1, 2")
    assert last.count() == intraday_bars(events).count()
    assert last.agg(F.sum("v")).first()[0] == events.where("value IS NOT NULL").count()


def test_running_variance_is_carried_over_batches(spark, tmp_path):
    from barloom.streaming.bars import running_variance

    close = walk(90, 5)["close"].to_numpy()
    rows = pd.DataFrame({"ticker": "T", "bar_start": pd.date_range("2024-01-01", periods=90, freq="h"), "close": close})
    for k in range(3):
        spark.createDataFrame(rows.iloc[30 * k : 30 * k + 30]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ticker string, bar_start timestamp, close double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = running_variance(stream, 0.1).writeStream.format("memory").queryName("variance_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM variance_out ORDER BY bar_start").toPandas()
    want, v = [np.nan], None
    for a, b in zip(close, close[1:]):
        v = (b - a) ** 2 if v is None else 0.9 * v + 0.1 * (b - a) ** 2
        want.append(v)
    np.testing.assert_allclose(got["variance"].astype(float), want)
