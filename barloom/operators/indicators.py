"""Technical indicators as columns (I1-I19), and their aggregation (A1-A3).

An indicator is a function (bars, settings) -> bars with its raw column `<name>` added, and a
normalisation from the raw column to -1..1. All windows run over (ticker, date) and so share one
shuffle; nothing reads a later row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import bounded, by_trailing_std, diff, ewm, lag, rolling, so_far, tanh_scaled, trailing_percentile, wilder

C = F.col


def or_null(x: Column) -> Column:
    """A divisor that gives null rather than an error where it is 0."""
    return F.nullif(x, F.lit(0.0))


def true_range() -> Column:
    """The first row has high - low."""
    before = lag("close")
    return F.greatest(C("high") - C("low"), F.abs(C("high") - before), F.abs(C("low") - before))


def typical() -> Column:
    return (C("high") + C("low") + C("close")) / 3


def moving_average_spread(df: DataFrame, s: dict) -> DataFrame:
    p = s["indicators"]["moving_average_spread"]
    df = ewm(df, C("close"), 2 / (p["fast_ema"] + 1), "__fast", p["fast_ema"])
    return df.withColumn("moving_average_spread", C("__fast") / rolling(F.avg("close"), "close", p["slow_sma"]) - 1).drop("__fast")


def macd(df: DataFrame, s: dict) -> DataFrame:
    p = s["indicators"]["macd"]
    df = ewm(ewm(df, C("close"), 2 / (p["fast"] + 1), "__fast"), C("close"), 2 / (p["slow"] + 1), "__slow")
    df = ewm(df, C("__fast") - C("__slow"), 2 / (p["signal"] + 1), "__signal")
    rows = F.count(F.lit(1)).over(so_far()) - 1
    raw = F.when(rows >= p["slow"] + p["signal"], (C("__fast") - C("__slow") - C("__signal")) / C("close"))
    return df.withColumn("macd", raw).drop("__fast", "__slow", "__signal")


def directional(df: DataFrame, period: int) -> DataFrame:
    """plus_di, minus_di and adx. The first row's directional move is 0, not missing."""
    up, down = diff(C("high")), -diff(C("low"))
    df = df.withColumns({"__plus": F.when((up > down) & (up > 0), up).otherwise(0.0), "__minus": F.when((down > up) & (down > 0), down).otherwise(0.0), "__tr": true_range()})
    for source, name in (("__tr", "__atr"), ("__plus", "__up"), ("__minus", "__down")):
        df = wilder(df, C(source), period, name)
    df = df.withColumns({"plus_di": 100 * C("__up") / or_null(C("__atr")), "minus_di": 100 * C("__down") / or_null(C("__atr"))})
    dx = 100 * F.abs(C("plus_di") - C("minus_di")) / or_null(C("plus_di") + C("minus_di"))
    return wilder(df.withColumn("__dx", dx), C("__dx"), period, "adx").drop("__plus", "__minus", "__tr", "__atr", "__up", "__down", "__dx")


def directional_movement(df: DataFrame, s: dict) -> DataFrame:
    kept = [c for c in df.columns if c not in ("plus_di", "minus_di", "directional_movement")]
    df = directional(df, s["indicators"]["directional_movement"]["period"])
    raw = (C("plus_di") - C("minus_di")) / or_null(C("plus_di") + C("minus_di"))
    return df.withColumn("directional_movement", raw).select(*[c for c in kept if c != "adx"], *(["adx"] if "adx" in kept else []), "directional_movement")


def adx(df: DataFrame, s: dict) -> DataFrame:
    return directional(df, s["indicators"]["adx"]["period"]).drop("plus_di", "minus_di")


def rsi(df: DataFrame, s: dict) -> DataFrame:
    n = s["indicators"]["rsi"]["period"]
    move = diff(C("close"))
    df = df.withColumns({"__gain": F.greatest(move, F.lit(0.0) * move), "__loss": F.greatest(-move, F.lit(0.0) * move)})
    df = wilder(wilder(df, C("__gain"), n, "__up"), C("__loss"), n, "__down")
    raw = F.when(C("__down") > 0, 100 - 100 / (1 + C("__up") / or_null(C("__down")))).when((C("__down") == 0) & (C("__up") > 0), 100.0)
    return df.withColumn("rsi", raw).drop("__gain", "__loss", "__up", "__down")


def stochastic(df: DataFrame, s: dict) -> DataFrame:
    p = s["indicators"]["stochastic"]
    low, high = rolling(F.min("low"), "low", p["period"]), rolling(F.max("high"), "high", p["period"])
    df = df.withColumn("__k", 100 * (C("close") - low) / or_null(high - low))
    return df.withColumn("stochastic", rolling(F.avg("__k"), "__k", p["smoothing"])).drop("__k")


def cci(df: DataFrame, s: dict) -> DataFrame:
    n = s["indicators"]["cci"]["period"]
    df = df.withColumn("__tp", typical())
    df = df.withColumns({"__mean": rolling(F.avg("__tp"), "__tp", n), "__held": rolling(F.collect_list("__tp"), "__tp", n)})
    away = F.aggregate("__held", F.lit(0.0), lambda total, v: total + F.abs(v - C("__mean"))) / n
    return df.withColumn("cci", (C("__tp") - C("__mean")) / or_null(0.015 * away)).drop("__tp", "__mean", "__held")


def bollinger_position(df: DataFrame, s: dict) -> DataFrame:
    p = s["indicators"]["bollinger"]
    mean, sd = rolling(F.avg("close"), "close", p["period"]), rolling(F.stddev_pop("close"), "close", p["period"])
    return df.withColumn("bollinger_position", (C("close") - mean) / or_null(p["width_in_std"] * sd))


def atr_percent(df: DataFrame, s: dict) -> DataFrame:
    df = wilder(df.withColumn("__tr", true_range()), C("__tr"), s["indicators"]["atr"]["period"], "__atr")
    return df.withColumn("atr_percent", C("__atr") / C("close")).drop("__tr", "__atr")


def bollinger_bandwidth(df: DataFrame, s: dict) -> DataFrame:
    p = s["indicators"]["bollinger"]
    mean, sd = rolling(F.avg("close"), "close", p["period"]), rolling(F.stddev_pop("close"), "close", p["period"])
    return df.withColumn("bollinger_bandwidth", 2 * p["width_in_std"] * sd / mean)


def realized_volatility(df: DataFrame, s: dict) -> DataFrame:
    df = df.withColumn("__r", diff(F.ln("close")))
    return df.withColumn("realized_volatility", rolling(F.stddev_samp("__r"), "__r", s["indicators"]["realized_volatility"]["window"])).drop("__r")


def obv_slope(df: DataFrame, s: dict) -> DataFrame:
    n = s["indicators"]["obv"]["slope_window"]
    df = df.withColumn("__flow", F.coalesce(F.signum(diff(C("close"))) * C("volume"), F.lit(0.0)))
    df = df.withColumn("__obv", F.sum("__flow").over(so_far()))
    return df.withColumn("obv_slope", diff(C("__obv"), n) / or_null(n * rolling(F.avg("volume"), "volume", n))).drop("__flow", "__obv")


def vwap_distance(df: DataFrame, s: dict) -> DataFrame:
    n = s["indicators"]["vwap"]["window"]
    df = df.withColumn("__tv", typical() * C("volume"))
    mean = rolling(F.sum("__tv"), "__tv", n) / or_null(rolling(F.sum("volume"), "volume", n))
    return df.withColumn("vwap_distance", C("close") / or_null(mean) - 1).drop("__tv")


def chaikin_money_flow(df: DataFrame, s: dict) -> DataFrame:
    n = s["indicators"]["chaikin_money_flow"]["period"]
    place = ((C("close") - C("low")) - (C("high") - C("close"))) / or_null(C("high") - C("low"))
    df = df.withColumn("__mf", F.coalesce(place, F.lit(0.0)) * C("volume"))
    return df.withColumn("chaikin_money_flow", rolling(F.sum("__mf"), "__mf", n) / or_null(rolling(F.sum("volume"), "volume", n))).drop("__mf")


def _std(x: Column, s: dict) -> Column:
    return by_trailing_std(x, s["normalization"]["scale_window"])


def _percentile(x: Column, s: dict) -> Column:
    return trailing_percentile(x, s["normalization"]["percentile_window"])


@dataclass(frozen=True)
class Indicator:
    """Raw column, category, whether its sign tells a direction, and its normalisation."""

    raw: Callable[[DataFrame, dict], DataFrame]
    category: str
    directional: bool
    normal: Callable[[Column, dict], Column]


#: All indicators by name, in the engine's order.
REGISTRY: dict[str, Indicator] = {
    "moving_average_spread": Indicator(moving_average_spread, "trend", True, _std),
    "macd": Indicator(macd, "trend", True, _std),
    "directional_movement": Indicator(directional_movement, "trend", True, lambda x, s: bounded(x, 0.0, 1.0)),
    "adx": Indicator(adx, "trend", False, lambda x, s: bounded(x, 25.0, 25.0)),
    "rsi": Indicator(rsi, "momentum", True, lambda x, s: bounded(x, 50.0, 50.0)),
    "stochastic": Indicator(stochastic, "momentum", True, lambda x, s: bounded(x, 50.0, 50.0)),
    "cci": Indicator(cci, "momentum", True, lambda x, s: tanh_scaled(x, s["normalization"]["cci_scale"])),
    "bollinger_position": Indicator(bollinger_position, "momentum", True, lambda x, s: bounded(x, 0.0, 1.0)),
    "atr_percent": Indicator(atr_percent, "volatility", False, _percentile),
    "bollinger_bandwidth": Indicator(bollinger_bandwidth, "volatility", False, _percentile),
    "realized_volatility": Indicator(realized_volatility, "volatility", False, _percentile),
    "obv_slope": Indicator(obv_slope, "volume", True, _std),
    "vwap_distance": Indicator(vwap_distance, "volume", True, _std),
    "chaikin_money_flow": Indicator(chaikin_money_flow, "volume", True, _std),
}


def compute(bars: DataFrame, name: str, settings: dict) -> DataFrame:
    """ticker, date, raw and normal value of one indicator."""
    one = REGISTRY[name]
    return one.raw(bars, settings).select("ticker", "date", C(name).alias("raw"), one.normal(C(name), settings).alias("normal"))


def compute_all(bars: DataFrame, settings: dict, names: list[str] | None = None) -> DataFrame:
    """The bars with all indicators' normal values, one column each, and adx_raw."""
    names = names or list(REGISTRY)
    df = bars
    for name in names:
        df = REGISTRY[name].raw(df, settings)
    extra = [C("adx").alias("adx_raw")] if "adx" in names else []
    return df.select(*bars.columns, *[REGISTRY[n].normal(C(n), settings).alias(n) for n in names], *extra)


def categories() -> dict[str, str]:
    return {n: i.category for n, i in REGISTRY.items()}


def correlations(normal: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """A1, first half: Pearson correlation of each pair over complete rows, in one aggregation."""
    complete = normal.where(" AND ".join(f"{n} IS NOT NULL" for n in names))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    wide = complete.groupBy(*(by or ["ticker"])).agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return wide.select(*(by or ["ticker"]), F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), C(f"`{a}|{b}`").alias("rho")) for a, b in pairs])).alias("x")).select(*(by or ["ticker"]), "x.*")


def prune(names: list[str], rho: np.ndarray, most: float) -> tuple[list[str], dict[str, tuple[str, float]]]:
    """A1, second half: by priority keep what correlates with no kept one beyond `most`; a dropped
    one is noted with its strongest twin."""
    kept: list[int] = []
    dropped: dict[str, tuple[str, float]] = {}
    for k in range(len(names)):
        twins = [(abs(rho[k, j]), j) for j in kept if abs(rho[k, j]) > most]
        if twins:
            j = max(twins, key=lambda t: t[0])[1]
            dropped[names[k]] = (names[j], float(rho[k, j]))
        else:
            kept.append(k)
    return [names[k] for k in kept], dropped


def pruned(normal: DataFrame, settings: dict) -> DataFrame:
    """A1: for each ticker the kept names and the dropped ones with twin and correlation. Only the
    13 x 13 correlations of a ticker meet in a group."""
    names, most = settings["redundancy"]["priority"], settings["redundancy"]["max_abs_correlation"]

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        rho = np.eye(len(names))
        at = {n: i for i, n in enumerate(names)}
        for a, b, r in zip(pdf["a"], pdf["b"], pdf["rho"], strict=True):
            rho[at[a], at[b]] = rho[at[b], at[a]] = 0.0 if r is None or np.isnan(r) else r
        kept, dropped = prune(names, rho, most)
        return pd.DataFrame([{"ticker": pdf["ticker"].iloc[0], "kept": kept, "dropped": {n: {"twin": t, "rho": r} for n, (t, r) in dropped.items()}}])

    return correlations(normal, names).groupBy("ticker").applyInPandas(choose, "ticker string, kept array<string>, dropped map<string,struct<twin:string,rho:double>>")


def composites(normal: DataFrame, kept: list[str], settings: dict) -> DataFrame:
    """A2: mean of each category's kept members; null if one of them is, or if there is none."""
    of = categories()
    out = {}
    for category in ("trend", "momentum", "volatility", "volume"):
        members = [n for n in kept if of[n] == category]
        out[category] = sum((C(n) for n in members[1:]), C(members[0])) / len(members) if members else F.lit(None).cast("double")
    return normal.withColumns(out)


def is_trending(adx_raw: Column, threshold: float) -> Column:
    """A3: 1.0 or 0.0; null stays null."""
    return F.when(adx_raw.isNotNull(), (adx_raw > threshold).cast("double"))


