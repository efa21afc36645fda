"""Return models and forecast samples that need no fitting loop."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import decaying_sum, ordered, so_far

C = F.col


def log_returns(bars: DataFrame) -> DataFrame:
    """ticker, date, nth (from 0), log price and daily log return (null on the first day)."""
    w = ordered()
    return bars.select("ticker", "date", (F.row_number().over(w) - 1).cast("long").alias("position"), "close", F.ln("close").alias("x"), (F.ln("close") - F.lag(F.ln("close")).over(w)).alias("r"))


def forward_return(horizon: int) -> Column:
    """Y2: the only look ahead; read through a mask of known outcomes alone."""
    return F.lead("x", horizon).over(ordered()) - C("x")


def gbm(returns: DataFrame) -> DataFrame:
    """M2 at every day at once: mean and sample deviation of all returns so far."""
    return returns.withColumns({"drift": F.avg("r").over(so_far()), "volatility": F.stddev_samp("r").over(so_far())})


def origins(returns: DataFrame, first: int, step: int, horizon: int) -> DataFrame:
    """B5's calendar: positions first, first + step, ... with a known outcome; the refit each belongs to."""
    n = F.count(F.lit(1)).over(Window.partitionBy("ticker"))
    rows = returns.withColumns({"n": n, "realized": forward_return(horizon)})
    return rows.where((C("position") >= first) & ((C("position") - first) % step == 0) & (C("position") < C("n") - horizon)).drop("n")


def refit_of(position: Column, first: int, step: int, every: int) -> Column:
    """Refits happen at the first origin at least `every` days after the last one."""
    per = -(-every // step)
    return F.floor((position - first) / (step * per))


def hash_uniform(*parts: Column) -> Column:
    """A uniform number in (0, 1) from the first 52 bits of an MD5, the same in any engine and layout."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def hash_normal(*parts: Column) -> Column:
    u, v = hash_uniform(*parts, F.lit("u")), hash_uniform(*parts, F.lit("v"))
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)


def gbm_paths(fits: DataFrame, horizon: int, paths: int, seed: int, band: float | None = None) -> DataFrame:
    """M1, M3: cumulative log returns of each origin's paths, one hashed shock a day, daily moves
    clipped at the band. Origins spread over tasks; paths never leave their row's task."""
    rows = fits.select("ticker", "date", "position", "realized", "drift", "volatility", F.explode(F.sequence(F.lit(1), F.lit(paths))).alias("path"))

    def day(k: int) -> Column:
        move = C("drift") + C("volatility") * hash_normal(F.lit(seed), C("ticker"), C("position"), C("path"), F.lit(k))
        return F.greatest(F.lit(math.log(1 - band)), F.least(F.lit(math.log(1 + band)), move)) if band else move

    return rows.select("ticker", "date", "position", "realized", "path", sum((day(k) for k in range(2, horizon + 1)), day(1)).alias("value"))


def merton_logpdf(x: Column, mu: float, sigma: float, intensity: float, jump_mean: float, jump_sigma: float, most: int) -> Column:
    """Log density of a Poisson mixture of normals with up to `most` jumps, by log-sum-exp."""
    terms = []
    for n in range(most + 1):
        variance = sigma**2 + n * jump_sigma**2
        constant = -intensity + n * math.log(intensity) - math.lgamma(n + 1) - 0.5 * math.log(2 * math.pi * variance)
        away = x - (mu + n * jump_mean)
        terms.append(F.lit(constant) - 0.5 * away * away / variance)
    top = F.greatest(*terms)
    return top + F.ln(sum((F.exp(t - top) for t in terms[1:]), F.exp(terms[0] - top)))


def garch_path(returns: DataFrame, omega: float, alpha: float, gamma: float, beta: float) -> DataFrame:
    """M5: by ticker the variance recursion over percent shocks, started by the unconditional
    variance; one row for each day, `variance` being that of the next day. The recursion is a
    decaying sum of what each day brings, taken in blocks, for any beta and length."""
    start = omega / (1 - alpha - gamma / 2 - beta)
    shocks = returns.where("r IS NOT NULL").withColumn("e", 100 * (C("r") - F.avg("r").over(Window.partitionBy("ticker"))))
    brought = omega + (alpha + F.when(C("e") < 0, gamma).otherwise(0.0)) * C("e") * C("e")
    summed = decaying_sum(shocks, brought, beta, "v")
    return summed.select("ticker", "date", "position", C("e").alias("shock"), (C("v") + start * F.pow(F.lit(beta), C("v_n") + 1)).alias("variance"))


def reaction_days(announcements: DataFrame, calendar: DataFrame, timezone: str, close_time: str) -> DataFrame:
    """M8: (ticker, date) of the first session that can react to each announcement: its own day
    before the close, else the next session. A forward as-of join by union and first value."""
    hour, minute = (int(p) for p in close_time.split(":"))
    local = F.from_utc_timestamp("announced_at", timezone)
    late = (F.hour(local) * 60 + F.minute(local) >= hour * 60 + minute).cast("int")
    earliest = announcements.select("ticker", F.date_add(F.to_date(local), late).alias("date"), F.lit(0).alias("side"))
    both = earliest.unionAll(calendar.select("ticker", "date", F.lit(1)))
    w = Window.partitionBy("ticker").orderBy("date", "side").rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn("session", F.first(F.when(C("side") == 1, C("date")), ignorenulls=True).over(w))
    return found.where("side = 0 AND session IS NOT NULL").select("ticker", C("session").alias("date")).distinct()


def earnings_multiplier(returns: DataFrame, days: DataFrame, least: int) -> DataFrame:
    """M9: mean squared shock on reaction days over that of other days, 1 at least; null with fewer
    than `least` reaction days."""
    flagged = returns.where("r IS NOT NULL").join(days.withColumn("on", F.lit(True)), ["ticker", "date"], "left").withColumn("m", F.avg("r").over(Window.partitionBy("ticker")))
    sq = (C("r") - C("m")) * (C("r") - C("m"))
    g = flagged.groupBy("ticker").agg(F.count("on").alias("events"), F.avg(F.when(C("on"), sq)).alias("a"), F.avg(F.when(C("on").isNull(), sq)).alias("b"))
    return g.select("ticker", "events", F.when(C("events") >= least, F.greatest(C("a") / C("b"), F.lit(1.0))).alias("multiplier"))


def horizon_multipliers(days: DataFrame, reactions: DataFrame, multiplier: DataFrame) -> DataFrame:
    """Shock scale of each forecast day: root of the multiplier on reaction days, else 1."""
    flagged = days.join(reactions.withColumn("on", F.lit(True)), ["ticker", "date"], "left").join(multiplier.select("ticker", "multiplier"), "ticker", "left")
    return flagged.select(*days.columns, F.when(C("on") & C("multiplier").isNotNull(), F.sqrt("multiplier")).otherwise(1.0).alias("scale"))


def ornstein_uhlenbeck(returns: DataFrame, horizon: int) -> DataFrame:
    """By ticker the AR(1) of log prices from moments: persistence, intercept, residual
    deviation; half-life, long-run price and drift over the horizon; null unless 0 < persistence < 1."""
    rows = returns.select("ticker", "position", C("x").alias("now"), F.lag("x").over(ordered()).alias("before"))
    g = rows.groupBy("ticker").agg(F.regr_slope("now", "before").alias("b"), F.regr_intercept("now", "before").alias("a"), F.regr_sxx("now", "before").alias("sxx"), F.regr_syy("now", "before").alias("syy"), F.count("before").alias("n"), F.max_by("now", "position").alias("last"))
    ok = (C("b") > 0) & (C("b") < 1)
    g = g.withColumns({"sd": F.sqrt((C("syy") - C("b") * C("b") * C("sxx")) / (C("n") - 2)), "level": C("a") / F.nullif(1 - C("b"), F.lit(0.0))})
    return g.select("ticker", C("b").alias("persistence"), F.when(ok, C("a")).alias("intercept"), F.when(ok, C("sd")).alias("residual_volatility"), F.when(ok, math.log(2) / -F.ln(F.when(ok, C("b")))).alias("half_life"), F.when(ok, F.exp("level")).alias("long_run_price"), F.when(ok, (C("level") - C("last")) * (1 - F.pow("b", F.lit(horizon))) / horizon).alias("daily_drift"))


def drift_prior(annual: Column | float, annual_sd: float, horizon: int, days: int) -> tuple[Column, float]:
    """Yearly drift and its deviation over the horizon, both in proportion."""
    return F.lit(annual) * (horizon / days) if not isinstance(annual, Column) else annual * (horizon / days), annual_sd * horizon / days


def next_trading_days(last: DataFrame, count: int) -> DataFrame:
    """The next weekdays after each ticker's last day, step counting from 1."""
    days = F.filter(F.sequence(F.date_add("date", 1), F.date_add("date", 2 * count + 4)), lambda d: ~F.dayofweek(d).isin(1, 7))
    return last.select("ticker", F.posexplode(F.slice(days, 1, count)).alias("step", "date")).withColumn("step", C("step") + 1)


def price_summary(samples: DataFrame, last_close: DataFrame, levels: list[float], thresholds: list[float]) -> DataFrame:
    """By ticker price intervals, median price and probabilities of moves from samples of log returns."""
    columns = [F.percentile("value", F.lit(0.5)).alias("mid")]
    for v in levels:
        columns += [F.percentile("value", F.lit((1 - v) / 2)).alias(f"low_{round(100 * v)}"), F.percentile("value", F.lit(1 - (1 - v) / 2)).alias(f"high_{round(100 * v)}")]
    columns += [F.avg((C("value") > 0).cast("double")).alias("p_up")]
    for t in thresholds:
        columns += [F.avg((C("value") > math.log1p(t)).cast("double")).alias(f"p_rise_{round(100 * t)}"), F.avg((C("value") <= math.log1p(-t)).cast("double")).alias(f"p_fall_{round(100 * t)}")]
    g = samples.groupBy("ticker").agg(*columns).join(last_close, "ticker")
    prices = [c for c in g.columns if c.startswith(("low_", "high_", "mid"))]
    return g.select("ticker", "close", *[(C("close") * F.exp(c)).alias("median_price" if c == "mid" else c) for c in prices], *[c for c in g.columns if c.startswith("p_")])
