"""Models that move on a stream against the batch filters."""

import numpy as np
import pandas as pd
import pytest
from conftest import walk
from pyspark.sql import functions as F

from barloom.operators import filters, forecasts
from barloom.streaming import model_state

STATES = ([0.6, 0.4], [[0.97, 0.03], [0.06, 0.94]], [0.0006, -0.0004], [0.00006, 0.0003])
TREND, GARCH = (0.0001, 0.4, 0.002), (0.05, 0.06, 0.08, 0.85)


def table(n: int = 60) -> pd.DataFrame:
    both = pd.concat([walk(n, 1, "A"), walk(n, 2, "B")])
    return both.assign(at=pd.to_datetime(both["date"]))[["ticker", "at", "date", "close"]]


def fits(spark, rows: pd.DataFrame, tickers=("A", "B")):
    mean = {t: np.diff(np.log(g["close"])).mean() for t, g in rows.groupby("ticker")}
    return spark.createDataFrame([(t, float(mean[t]), *GARCH, *STATES, *TREND) for t in tickers], model_state.FITS)


def batch(spark, rows: pd.DataFrame) -> pd.DataFrame:
    returns = forecasts.log_returns(spark.createDataFrame(rows[["ticker", "date", "close"]]))
    out = returns.select("ticker", "date").join(forecasts.garch_path(returns, *GARCH).select("ticker", "date", "variance"), ["ticker", "date"], "left")
    out = out.join(filters.regime_probability(returns, *STATES).select("ticker", "date", "turbulent"), ["ticker", "date"]).join(filters.trend_strength(returns, *TREND).select("ticker", "date", "slope_z"), ["ticker", "date"])
    return out.orderBy("ticker", "date").toPandas()


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    got = got.sort_values(["ticker", "at"]).reset_index(drop=True)
    assert len(got) == len(want) and list(got["ticker"]) == list(want["ticker"])
    for c in ("variance", "turbulent", "slope_z"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-7, atol=1e-10)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, model_state.ROCKS)
    yield
    spark.conf.set(key, before)


def test_replay_equals_batch(spark):
    rows = table()
    got = model_state.replay(spark.createDataFrame(rows[["ticker", "at", "close"]]), fits(spark, rows)).toPandas()
    same(got, batch(spark, rows))


def run(spark, folder: str, start, late: str = "3 days") -> dict:
    stream = spark.readStream.schema("ticker string, at timestamp, close double").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = model_state.running_models(stream, start, late).writeStream.format("parquet").option("checkpointLocation", f"{folder}/c").option("path", f"{folder}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return {"dropped": sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])}


def put(spark, folder: str, rows: list[tuple]) -> None:
    spark.createDataFrame(pd.DataFrame(rows, columns=["ticker", "at", "close"])).coalesce(1).write.mode("append").parquet(f"{folder}/in")


END = [[("", pd.Timestamp("2040-01-01"), 1.0)], [("", pd.Timestamp("2040-01-02"), 1.0)]]


def test_restart_disorder_and_late_bars(spark, tmp_path, rocks):
    """Bars out of order inside the watermark's delay, a restart from the checkpoint with other fits (which
    then no longer count), bars that repeat a time, and a bar that is too late."""
    rows = table(40)
    every = list(rows[["ticker", "at", "close"]].itertuples(index=False, name=None))
    every.sort(key=lambda r: r[1])
    rng, folder = np.random.default_rng(4), str(tmp_path)
    first, second = every[:40], every[40:]
    shuffled = [first[i] for k in range(0, 40, 4) for i in k + rng.permutation(4)]
    put(spark, folder, shuffled + [(*first[-1][:2], -1.0)] + [first[-1]])  # of one time the last to arrive counts
    run(spark, folder, fits(spark, rows), "9 days")
    put(spark, folder, [second[i] for k in range(0, 40, 4) for i in k + rng.permutation(4)])
    put(spark, folder, END[0])
    put(spark, folder, END[1])
    put(spark, folder, [("A", pd.Timestamp("2015-01-03"), 77.0)])
    told = run(spark, folder, fits(spark, rows.assign(close=1.0)), "9 days")
    assert told["dropped"] == 1
    same(spark.read.parquet(f"{folder}/out").where("ticker != ''").toPandas(), batch(spark, rows))


def test_ticker_without_fit(spark):
    rows = table(10)
    got = model_state.replay(spark.createDataFrame(rows[["ticker", "at", "close"]]), fits(spark, rows, ("A",)), 2)
    counted = {r["ticker"]: r for r in got.groupBy("ticker").agg(F.count("*").alias("n"), F.count("variance").alias("v"), F.count("slope_z").alias("z")).collect()}
    assert counted["A"]["v"] == 9 and counted["A"]["z"] == 8 and counted["B"]["n"] == 10 and counted["B"]["v"] == 0


def test_needs_rocks(spark):
    with pytest.raises(ValueError, match="stateStore"):
        model_state.running_models(spark.readStream.format("rate").load().selectExpr("'A' AS ticker", "timestamp AS at", "1.0D AS close"), fits(spark, table(5)))
