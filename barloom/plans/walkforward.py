"""Walk-forward test and live forecast.

Prepared features are native columns. A range of refits with the origins that use them is one row
with its ticker's series as arrays, cut after the range's last outcome; rows are dealt over tasks, so
that one ticker spreads as well as many. Inside a range each fit starts from the last.
Candidates are simulated and scored where they are fitted; only scores and the fits (as JSON)
leave. The engine's volatility model is then chosen by a window over the scores, and the engine
simulated from the stored fits.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import ordered
from ..models.numeric import generator
from ..models.returns import Suite, drift_posterior, simulate
from ..operators import evaluate
from ..operators.forecasts import forward_return, reaction_days
from ..operators.indicators import categories, compute_all, is_trending, prune
from .durable import durable

C = F.col
#: Refits in one row of work: a range's first fit is cold, the others start from the one before.
RANGE = 8
EVIDENCE = ["trend", "momentum", "volatility", "volume", "kalman_trend", "trend_when_trending", "momentum_when_trending"]


def prepare(bars: DataFrame, announcements: DataFrame, settings: dict) -> DataFrame:
    """B1: one row for each ticker and date: position, log price, normal indicators, trending,
    whether it is a results reaction day, and the forward return."""
    names = settings["redundancy"]["priority"]
    market = settings["market"]
    features = compute_all(bars, settings, [*names, "adx"])
    days = reaction_days(announcements, bars.select("ticker", "date"), market["exchange_timezone"], market["market_close_time"])
    flagged = features.join(days.withColumn("__on", F.lit(True)), ["ticker", "date"], "left")
    out = flagged.withColumns({"position": (F.row_number().over(ordered()) - 1).cast("int"), "x": F.ln("close"), "trending": is_trending(C("adx_raw"), settings["regimes"]["trend_adx_threshold"]), "reaction": F.coalesce("__on", F.lit(False))})
    return out.withColumn("forward", forward_return(settings["forecast"]["horizon_days"])).select("ticker", "date", "position", "x", "forward", "trending", "reaction", *names)


def series(prepared: DataFrame, names: list[str]) -> DataFrame:
    """A ticker's history as arrays in one row, some hundred kilobytes for a decade of days."""
    held = F.array_sort(F.collect_list(F.struct("position", "date", "x", "forward", "trending", "reaction", *names)))
    return prepared.groupBy("ticker").agg(held.alias("s")).select("ticker", *[C("s")[c].alias(c) for c in ("date", "x", "forward", "trending", "reaction", *names)])


def evidence_matrix(indicators: dict[str, np.ndarray], kept: list[str], slope_z: np.ndarray, trending: np.ndarray) -> np.ndarray:
    """Composites of kept indicators by category, Kalman trend, and trend and momentum where trending."""
    of = categories()
    out = []
    for category in EVIDENCE[:4]:
        members = [indicators[n] for n in kept if of[n] == category]
        out.append(np.mean(members, 0) if members else np.full(len(trending), np.nan))
    out += [slope_z, out[0] * trending, out[1] * trending]
    return np.column_stack(out)


def multiplier_of(returns: np.ndarray, on: np.ndarray, least: int) -> float | None:
    """M9 over the returns known at an origin."""
    if on.sum() < least:
        return None
    sq = (returns - returns.mean()) ** 2
    return max(1.0, float(sq[on].mean() / sq[~on].mean()))


def correlation_matrix(columns: list[np.ndarray]) -> np.ndarray:
    rows = np.column_stack(columns)
    rows = rows[~np.isnan(rows).any(1)]
    if len(rows) < 3:
        return np.eye(len(columns))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.nan_to_num(np.corrcoef(rows.T))


def score_samples(values: np.ndarray, realized: float, levels: list[float]) -> dict:
    """E1-E4 inside a group."""
    v = np.sort(values)
    n = len(v)
    p_up = float((v > 0).mean())
    q = np.quantile(v, [t for level in levels for t in ((1 - level) / 2, 1 - (1 - level) / 2)])
    out = {"crps": float(np.abs(v - realized).mean() - ((2 * np.arange(1, n + 1) - n - 1) * v).sum() / n**2), "pit": float((np.searchsorted(v, realized, "left") + np.searchsorted(v, realized, "right")) / 2 / n), "p_up": p_up, "brier": (p_up - (realized > 0)) ** 2}
    return out | {evaluate.level_name(level): bool(q[2 * k] <= realized <= q[2 * k + 1]) for k, level in enumerate(levels)}


def arrays_of(row, names: list[str]) -> dict[str, np.ndarray]:
    number = lambda a: np.array([np.nan if v is None else v for v in a], float)
    return {"date": np.array(row["date"], object), "reaction": np.array(row["reaction"], bool), **{c: number(row[c]) for c in ("x", "forward", "trending", *names)}}


def fit_at(s: dict, names: list[str], start: int, position: int, settings: dict, rng: np.random.Generator, warm: Suite | None) -> tuple[Suite, list[str], dict]:
    """Y5 and A1 at a refit: all fits on data up to the position; kept and dropped indicators."""
    window = slice(start, position + 1)
    returns, on = np.diff(s["x"][window]), s["reaction"][start + 1 : position + 1]
    suite = Suite.fit(s["x"][window], multiplier_of(returns, on, settings["models"]["earnings"]["min_events"]), settings, rng, warm)
    kept, dropped = prune(names, correlation_matrix([s[n][window] for n in names]), settings["redundancy"]["max_abs_correlation"])
    return suite, kept, dropped


def posterior_at(s: dict, suite: Suite, names: list[str], kept: list[str], start: int, position: int, settings: dict, tilt: float = 0.0):
    """Evidence up to the position and the drift posterior; outcomes not yet known are masked."""
    horizon, bayes, days = settings["forecast"]["horizon_days"], settings["bayes"], settings["market"]["trading_days_per_year"]
    window = slice(start, position + 1)
    evidence = evidence_matrix({n: s[n][window] for n in names}, kept, suite.trend.slope_z(s["x"][window]), s["trending"][window])
    known = s["forward"][window].copy()
    known[-horizon:] = np.nan
    scale = horizon / days
    return evidence, drift_posterior(evidence, EVIDENCE, known, position - start, horizon=horizon, prior_mean=(bayes["prior_annual_drift"] + tilt) * scale, prior_sd=bayes["prior_annual_drift_sd"] * scale, effect_sd=bayes["signal_effect_prior_sd"])


def test_origins(prepared: DataFrame, settings: dict) -> DataFrame:
    """B5's calendar by ticker: refit number and its origins."""
    walk, horizon = settings["walk_forward"], settings["forecast"]["horizon_days"]
    step, first = walk["forecast_every_days"], walk["min_training_days"]
    per = -(-walk["refit_every_days"] // step)
    n = prepared.groupBy("ticker").agg(F.count(F.lit(1)).cast("int").alias("n")).where(C("n") > first + horizon)
    each = n.select("ticker", F.explode(F.sequence(F.lit(first), C("n") - horizon - 1, F.lit(step))).alias("position"))
    refit = F.floor((C("position") - first) / (step * per))
    return each.groupBy("ticker", refit.alias("refit")).agg(F.array_sort(F.collect_list("position")).alias("positions"))


def record_schema(levels: list[float]) -> str:
    return "ticker string, date date, position int, refit long, model string, realized double, crps double, pit double, p_up double, brier double, " + ", ".join(f"{evaluate.level_name(v)} boolean" for v in levels) + ", turbulent_probability double, trending double, earnings_in_window boolean, ou_active boolean, drift_mean double, drift_sd double, scale array<double>, suite string, note string"


WORK = "ticker string, range long, todo array<struct<refit:long,positions:array<int>,fitted:boolean>>, warm string, kept array<string>"


def all_work(prepared: DataFrame, settings: dict, mode: str) -> DataFrame:
    """Every refit with its origins, by ranges of refits (columns WORK), nothing fitted before."""
    part = F.lit(0) if mode == "serial" else F.floor(C("refit") / RANGE)
    refits = test_origins(prepared, settings).groupBy("ticker", part.cast("long").alias("range")).agg(F.array_sort(F.collect_list(F.struct("refit", "positions", F.lit(False).alias("fitted")))).alias("todo"))
    return refits.select("*", F.lit(None).cast("string").alias("warm"), F.lit(None).cast("array<string>").alias("kept"))


def candidates(prepared: DataFrame, settings: dict, mode: str = "parallel", work: DataFrame | None = None) -> DataFrame:
    """Scores of all candidate models at all origins, and a row `engine` for each origin with what
    the engine needs (drift posterior, fits). Each fit starts from the last one: in mode parallel
    within ranges of RANGE refits, in mode serial over all refits of a ticker. `work` (columns WORK)
    names the refits and origins to run, with the fits that their range starts from (`warm`) and, where
    its first refit is fitted already, the indicators that it kept."""
    names, levels, horizon = settings["redundancy"]["priority"], settings["forecast"]["interval_levels"], settings["forecast"]["horizon_days"]
    walk, paths, seed = settings["walk_forward"], settings["forecast"]["monte_carlo_paths"], settings["forecast"]["random_seed"]
    refits = all_work(prepared, settings, mode) if work is None else work
    upto = F.array_max(F.transform("todo", lambda x: F.array_max(x["positions"]))) + horizon + 1
    held = series(prepared, names)
    rows = refits.join(held, "ticker").select("ticker", "range", "todo", "warm", C("kept").alias("kept_before"), *[F.slice(c, F.lit(1), upto).alias(c) for c in held.columns if c != "ticker"])
    spread = rows.repartition(max(1, rows.sparkSession.sparkContext.defaultParallelism * 2), "ticker", "range")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                s, ticker = arrays_of(row, names), row["ticker"]
                suite = Suite.from_json(row["warm"]) if row["warm"] else None
                kept = None if row["kept_before"] is None else list(row["kept_before"])
                band = settings["market"]["price_bands"].get(ticker)
                out = []
                for todo in row["todo"]:
                    refit = int(todo["refit"])
                    for k, position in enumerate(int(p) for p in todo["positions"]):
                        start = 0 if walk["max_training_days"] is None else max(0, position + 1 - walk["max_training_days"])
                        if k == 0 and not todo["fitted"]:
                            suite, kept, dropped = fit_at(s, names, start, position, settings, generator(seed, ticker, position, "fit"), suite)
                            note = {"kept": kept, "dropped": dropped, "adf_statistic": suite.adf["statistic"], "adf_rejects_unit_root": suite.adf["stationary"], "multiplier": suite.multiplier, "garch_persistence": suite.garch.persistence, "garch_tail_dof": suite.garch.nu}
                        else:
                            suite, note = suite.moved_to(s["x"][start : position + 1]), None
                        _, post = posterior_at(s, suite, names, kept, start, position, settings)
                        ahead = s["reaction"][position + 1 : position + horizon + 1]
                        scale = np.where(ahead, np.sqrt(suite.multiplier or 1.0), 1.0)
                        realized = float(s["x"][position + horizon] - s["x"][position])
                        common = {"ticker": ticker, "date": s["date"][position], "position": position, "refit": refit, "realized": realized, "turbulent_probability": suite.regimes.turbulent, "trending": s["trending"][position], "earnings_in_window": bool(ahead.any()), "ou_active": suite.reverting is not None, "scale": None, "suite": None, "note": None}
                        for name, model in suite.candidates().items():
                            values = simulate(model, horizon, paths, generator(seed, ticker, position, name), scale=scale if name == "garch_t_earnings" else None, band=band)
                            out.append(common | {"model": name} | score_samples(values, realized, levels))
                        out.append(common | {"model": "engine", "drift_mean": post.mean, "drift_sd": post.sd, "suite": suite.to_json(), "scale": scale.tolist(), "note": json.dumps(note) if note else None})
                columns = [c.split(" ")[0] for c in record_schema(levels).split(", ")]
                yield pd.DataFrame(out).reindex(columns=columns) if out else pd.DataFrame(columns=columns)

    return spread.mapInPandas(run, record_schema(levels))


def engine(scored: DataFrame, settings: dict, only: DataFrame | None = None) -> DataFrame:
    """The engine's records: the volatility model that did best by then, its shocks
    about one drift drawn for each path; of the origins of `only` (ticker, position), if given."""
    levels, horizon = settings["forecast"]["interval_levels"], settings["forecast"]["horizon_days"]
    walk, paths, seed = settings["walk_forward"], settings["forecast"]["monte_carlo_paths"], settings["forecast"]["random_seed"]
    chosen = evaluate.chosen_models(scored, horizon, walk["min_scored_forecasts_for_model_selection"], walk["default_volatility_model"])
    todo = scored.where("model = 'engine'").join(chosen.select("ticker", "position", "chosen"), ["ticker", "position"])
    todo = todo if only is None else todo.join(only.select("ticker", "position"), ["ticker", "position"], "left_semi")
    schema = record_schema(levels) + ", chosen string"
    columns = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                suite, rng = Suite.from_json(row["suite"]), generator(seed, row["ticker"], row["position"], "engine")
                drift = rng.normal(row["drift_mean"], row["drift_sd"], paths) / horizon
                scale = np.asarray(row["scale"], float) if row["chosen"] == "garch_t_earnings" else None
                values = simulate(suite.candidates()[row["chosen"]], horizon, paths, rng, drift=drift, scale=scale, band=settings["market"]["price_bands"].get(row["ticker"]))
                out.append(row | score_samples(values, row["realized"], levels) | {"suite": None})
            yield pd.DataFrame(out).reindex(columns=columns) if out else pd.DataFrame(columns=columns)

    return todo.mapInPandas(run, schema)


def walk_forward(prepared: DataFrame, settings: dict, mode: str = "parallel") -> tuple[DataFrame, DataFrame]:
    """(records of all models and the engine, refit log). The candidate stage is written to
    the checkpoint folder, so that lost executors cost no refit twice."""
    scored = durable(candidates(prepared, settings, mode))
    records = scored.where("model != 'engine'").drop("suite", "note", "scale").withColumn("chosen", F.lit(None).cast("string")).unionByName(engine(scored, settings).drop("suite", "note", "scale"))
    log = scored.where("note IS NOT NULL").select("ticker", "date", "refit", F.from_json("note", "kept array<string>, dropped map<string,array<string>>, adf_statistic double, adf_rejects_unit_root boolean, multiplier double, garch_persistence double, garch_tail_dof double").alias("n")).select("ticker", "date", "refit", "n.*")
    return records, log
