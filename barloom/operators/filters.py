"""Filters of given parameters over all days of a ticker (M14, M18, Y3): one group for each ticker,
a decade of days being some thousand numbers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..models.returns import Regimes, Trend, drift_posterior


def by_ticker(returns: DataFrame, of: Callable[[pd.DataFrame], dict], columns: str) -> DataFrame:
    """ticker, date, position and what `of` gives for a ticker's days in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        return pdf[["ticker", "date", "position"]].assign(**of(pdf))

    return returns.select("ticker", "date", "position", "x", "r").groupBy("ticker").applyInPandas(run, f"ticker string, date date, position long, {columns}")


def regime_probability(returns: DataFrame, start: list[float], transition: list[list[float]], means: list[float], variances: list[float]) -> DataFrame:
    """Each day's probability of the last state, given the returns so far; null on the first day."""
    model = Regimes(start, transition, means, variances, start, 0.0, 0, 1)
    return by_ticker(returns, lambda pdf: {"turbulent": np.append(np.nan, model.filtered(pdf["x"].to_numpy())[:, -1])[: len(pdf)]}, "turbulent double")


def trend_strength(returns: DataFrame, level_variance: float, observation_ratio: float, slope_ratio: float) -> DataFrame:
    """Each day's filtered slope over its deviation; null in the burn-in."""
    model = Trend(level_variance, observation_ratio, slope_ratio, True)
    return by_ticker(returns, lambda pdf: {"slope_z": model.slope_z(pdf["x"].to_numpy())}, "slope_z double")


def prior_and_outcomes(returns: DataFrame, *, horizon: int, prior_mean: float, prior_sd: float) -> DataFrame:
    """Y3 without evidence: the drift posterior of each ticker's last day from known outcomes alone."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("position")["x"].to_numpy()
        forward = np.append(x[horizon:] - x[:-horizon], np.full(horizon, np.nan)) if len(x) > horizon else np.full(len(x), np.nan)
        post = drift_posterior(np.full((len(x), 1), np.nan), ["none"], forward, len(x) - 1, horizon=horizon, prior_mean=prior_mean, prior_sd=prior_sd, effect_sd=1.0)
        return pd.DataFrame([{"ticker": pdf["ticker"].iloc[0], "outcomes": post.rows, "mean": post.mean, "sd": post.sd}])

    return returns.select("ticker", "position", "x").groupBy("ticker").applyInPandas(run, "ticker string, outcomes long, mean double, sd double")
