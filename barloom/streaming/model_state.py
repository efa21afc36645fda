"""Fitted models that move bar by bar on a stream: GARCH variance, regime probabilities, trend.

The state of a ticker is typed: a value for its place in the series, one for the variance, one for the
trend, a map of regimes, and a map of bars that wait for their turn. Fits come in as the initial state.
Bars may arrive in any order within the watermark's delay: a bar waits until the watermark has passed
it, when an event-time timer lets all waiting bars through in order, so that the result equals that
of the batch filters over the same bars. Of bars with one time the last to arrive counts. Bars older than
the watermark are dropped by Spark, which counts them in the query's progress
(numRowsDroppedByWatermark). A ticker without a fit passes with null figures.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..models.returns import BURN_IN, DIFFUSE, PERCENT
from ..plans.durable import removed, shared_folder

C = F.col
OUT = "ticker string, at timestamp, close double, variance double, turbulent double, slope_z double"
FITS = "ticker string, mean double, omega double, alpha double, gamma double, beta double, start array<double>, transition array<array<double>>, means array<double>, variances array<double>, level_variance double, observation_ratio double, slope_ratio double"
PLACE = "bars long, last_at long, log_price double"
GARCH = "mean double, omega double, alpha double, gamma double, beta double, variance double"
TREND = "level_variance double, observation_ratio double, slope_ratio double, level double, tilt double, a double, c double, b double"
REGIME = "mean double, variance double, probability double, moves array<double>"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def next_variance(g: dict, r: float) -> dict:
    """M5, a day on: the variance of the day after the return."""
    e = PERCENT * (r - g["mean"])
    return g | {"variance": g["omega"] + (g["alpha"] + (g["gamma"] if e < 0 else 0.0)) * e * e + g["beta"] * g["variance"]}


def next_regimes(states: list[dict], r: float, first: bool) -> list[dict]:
    """M14, a day on; on the first return the probabilities are those of the start."""
    p = np.array([s["probability"] for s in states])
    if not first:
        p = p @ np.array([s["moves"] for s in states])
    variance = np.array([s["variance"] for s in states])
    logs = -0.5 * (r - np.array([s["mean"] for s in states])) ** 2 / variance - 0.5 * np.log(variance)
    p = p * np.exp(logs - logs.max())
    return [s | {"probability": float(v)} for s, v in zip(states, p / p.sum(), strict=True)]


def next_trend(t: dict, x: float, first: bool) -> dict:
    """M18, a day on: level, slope and their covariance in units of the level's variance."""
    q = t["observation_ratio"]
    if first:
        return t | {"level": x, "tilt": 0.0, "a": DIFFUSE * q / (DIFFUSE + q), "c": 0.0, "b": DIFFUSE}
    a, c, b = t["a"] + 2 * t["c"] + t["b"] + 1, t["c"] + t["b"], t["b"] + t["slope_ratio"]
    v, e = a + q, x - t["level"] - t["tilt"]
    return t | {"level": t["level"] + t["tilt"] + a / v * e, "tilt": t["tilt"] + c / v * e, "a": a - a * a / v, "c": c - a * c / v, "b": b - c * c / v}


def names(schema: str) -> list[str]:
    return [part.split(" ")[0] for part in schema.split(", ")]


class ModelState(StatefulProcessor):
    """The states of one ticker, and what moves them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", PLACE)
        self.garch = handle.getValueState("garch", GARCH)
        self.trend = handle.getValueState("trend", TREND)
        self.regimes = handle.getMapState("regimes", "state int", REGIME)
        self.waiting = handle.getMapState("waiting", "at long", "close double")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        f = initialState.iloc[0]
        lasting = f["alpha"] + f["gamma"] / 2 + f["beta"]
        self.garch.update((*(float(f[c]) for c in names(GARCH)[:-1]), float(f["omega"] / (1 - lasting))))
        self.trend.update((*(float(f[c]) for c in names(TREND)[:3]), 0.0, 0.0, 0.0, 0.0, 0.0))
        for k, (start, mean, variance) in enumerate(zip(f["start"], f["means"], f["variances"], strict=True)):
            self.regimes.updateValue((k,), (float(mean), float(variance), float(start), [float(v) for v in f["transition"][k]]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            for at, close in zip(pdf["at"], pdf["close"], strict=True):
                ms = int(pd.Timestamp(at).timestamp() * 1000)
                self.waiting.updateValue((ms,), (float(close),))
                first = ms if first is None else min(first, ms)
        if first is not None:
            self.handle.registerTimer(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen = timerValues.getCurrentWatermarkInMs()
        bars = sorted((k[0], v[0]) for k, v in self.waiting.iterator())
        due = [bar for bar in bars if bar[0] <= seen]
        if len(due) < len(bars):
            self.handle.registerTimer(bars[len(due)][0])
        if not due:
            return
        count, _, x = self.place.get() if self.place.exists() else (0, 0, None)
        fitted = self.garch.exists()
        g = dict(zip(names(GARCH), self.garch.get(), strict=True)) if fitted else None
        t = dict(zip(names(TREND), self.trend.get(), strict=True)) if fitted else None
        states = [dict(zip(names(REGIME), v, strict=True)) for _, v in sorted(self.regimes.iterator(), key=lambda kv: kv[0][0])] if fitted else []
        out = []
        for at, close in due:
            now = math.log(close)
            figures: tuple = (None, None, None)
            if fitted:
                if count:
                    g, states = next_variance(g, now - x), next_regimes(states, now - x, count == 1)
                t = next_trend(t, now, count == 0)
                figures = (g["variance"] if count else None, states[-1]["probability"] if count else None, t["tilt"] / math.sqrt(t["b"] * t["level_variance"]) if count >= BURN_IN else None)
            out.append((key[0], pd.Timestamp(at, unit="ms"), close, *figures))
            x, count = now, count + 1
            self.waiting.removeKey((at,))
        self.place.update((count, due[-1][0], x))
        if fitted:
            self.garch.update(tuple(g.values()))
            self.trend.update(tuple(t.values()))
            for k, s in enumerate(states):
                self.regimes.updateValue((k,), (s["mean"], s["variance"], s["probability"], list(s["moves"])))
        frame = pd.DataFrame(out, columns=names(OUT))
        yield frame.astype({c: float for c in ("variance", "turbulent", "slope_z")})

    def close(self) -> None:
        pass


def running_models(bars: DataFrame, fits: DataFrame, late: str = "3 days") -> DataFrame:
    """A stream of bars (ticker, at, close) with each bar's figures, once the watermark (`late` behind the
    newest bar) has passed it. `fits` (columns FITS) is read when the stream first starts; a restart goes
    on from the checkpoint. The session's state store must be RocksDB."""
    spark = bars.sparkSession
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKS}")
    keyed = bars.select("ticker", "at", "close").withWatermark("at", late).groupBy("ticker")
    return keyed.transformWithStateInPandas(statefulProcessor=ModelState(), outputStructType=OUT, outputMode="append", timeMode="eventtime", initialState=fits.select(*names(FITS)).groupBy("ticker"))


def replay(bars: DataFrame, fits: DataFrame, parts: int = 3) -> DataFrame:
    """Streams a table of bars through the models: in `parts` batches in order of time, then two empty
    ends by which the watermark passes the last bar. The folder of the stream stays in the shared folder."""
    spark = bars.sparkSession
    folder = shared_folder(spark, "replay")
    rows = bars.select("ticker", "at", "close")
    edges = rows.select(F.percentile(F.unix_timestamp("at"), F.array(*[F.lit(k / parts) for k in range(1, parts)])).alias("e"), F.max("at").alias("last")).first()
    part = sum(((F.unix_timestamp("at") > e).cast("int") for e in edges["e"] or []), F.lit(0))
    cut = rows.withColumn("part", part)
    for k in range(parts):
        cut.where(C("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    for days in (3_650, 3_651):
        end = rows.limit(1).select(F.lit("").alias("ticker"), (F.lit(edges["last"]) + F.expr(f"INTERVAL {days} DAYS")).cast("timestamp").alias("at"), "close")
        end.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKS)
    try:
        stream = spark.readStream.schema("ticker string, at timestamp, close double").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        query = running_models(stream, fits).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(setting, before)
    out = spark.read.schema(OUT).parquet(f"{folder}/out")
    removed(spark, f"{folder}/in", f"{folder}/checkpoint")
    return out
