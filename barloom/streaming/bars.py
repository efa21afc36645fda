"""Bars of an event stream, and a running volatility over them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

C = F.col


def intraday_bars(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Open, high, low, close and count of values by event type and window. On a stream, windows
    close once the watermark passes them; later events are dropped. Works on a batch as well."""
    timed = events.withColumn("ts", C("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    at = F.struct("ts", "event_id")
    g = timed.groupBy(F.window("ts", width), C("event_type").alias("ticker")).agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("value").cast("double").alias("volume"))
    return g.select("ticker", C("window.start").alias("bar_start"), "open", "high", "low", "close", "volume")


def running_variance(bars: DataFrame, alpha: float = 0.06) -> DataFrame:
    """Exponentially weighted variance of close-to-close moves of each ticker, carried from batch to
    batch as state (last close, variance); one row for each bar."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, variance = state.get if state.exists else (None, None)
        rows = pd.concat(list(parts)).sort_values("bar_start")
        out = []
        for start, close in zip(rows["bar_start"], rows["close"], strict=True):
            if last is not None:
                move = (close - last) ** 2
                variance = move if variance is None else (1 - alpha) * variance + alpha * move
            last = close
            out.append((key[0], start, close, variance))
        state.update((last, variance))
        yield pd.DataFrame(out, columns=["ticker", "bar_start", "close", "variance"])

    return bars.groupBy("ticker").applyInPandasWithState(step, "ticker string, bar_start timestamp, close double, variance double", "last double, variance double", "append", GroupStateTimeout.NoTimeout)
