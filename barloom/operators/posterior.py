"""The drift posterior in columns (Y1, Y3): evidence, known outcomes, one Gram matrix, one solve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linear import gram, swept_all

C = F.col
EVIDENCE = ["trend", "momentum", "volatility", "volume", "kalman_trend", "trend_when_trending", "momentum_when_trending"]


def evidence(prepared: DataFrame, slopes: DataFrame, members: dict[str, list[str]]) -> DataFrame:
    """By ticker and position the seven pieces of evidence and the forward return. `prepared` has
    position, trending, forward and the indicators; `slopes` (ticker, position, slope_z) the trend filter's;
    `members` the kept indicators of each category."""
    mean = {c: sum((C(n) for n in ns[1:]), C(ns[0])) / len(ns) if ns else F.lit(None).cast("double") for c, ns in members.items()}
    rows = prepared.select("ticker", "position", "forward", "trending", *[m.alias(c) for c, m in mean.items()]).join(slopes.select("ticker", "position", C("slope_z").alias("kalman_trend")), ["ticker", "position"])
    return rows.withColumns({f"{c}_when_trending": C(c) * C("trending") for c in ("trend", "momentum")}).select("ticker", "position", "forward", *EVIDENCE)


def drift_posteriors(rows: DataFrame, *, horizon: int, prior_mean: float, prior_sd: float, effect_sd: float, names: list[str] = EVIDENCE, least_rows: int = 20, least_known: int = 30) -> DataFrame:
    """Y3 of each ticker's last day: ticker, outcomes, mean, sd, baseline, and the contribution of each
    piece of evidence (null where it takes no part).

    Bayesian linear regression of forward returns on standardised evidence over the non-overlapping days whose
    outcome is known; the prior alone below `least_rows` of them. Evidence needs `least_known` known
    values that vary; where today's is unknown it counts as average. Two aggregations give means and
    deviations, a third the Gram matrix; the posterior is one solve by sweeps. No series is gathered."""
    p = len(names) + 2
    w = Window.partitionBy("ticker")
    told = rows.withColumn("origin", F.max("position").over(w))
    today = told.where("position = origin").select("ticker", *[C(c).alias(f"now_{c}") for c in names])
    before = told.where((C("position") % horizon == C("origin") % horizon) & (C("position") <= C("origin") - horizon)).select("ticker", "forward", *names)
    known = before.groupBy("ticker").agg(*[((F.count(c) >= least_known) & (F.stddev_samp(c) > 1e-12)).alias(f"in_{c}") for c in names])
    whole = C("forward").isNotNull()
    for c in names:
        whole = whole & (C(c).isNotNull() | ~C(f"in_{c}"))
    known = known.select("ticker", *[F.coalesce(f"in_{c}", F.lit(False)).alias(f"in_{c}") for c in names])
    complete = before.join(known, "ticker").where(whole)
    moments = complete.groupBy("ticker").agg(F.count(F.lit(1)).alias("outcomes"), F.var_samp("forward").alias("v"), *[F.avg(c).alias(f"mean_{c}") for c in names], *[F.stddev_samp(c).alias(f"sd_{c}") for c in names])
    z = lambda c, x: F.when(C(f"in_{c}"), (x - C(f"mean_{c}")) / F.nullif(C(f"sd_{c}"), F.lit(0.0))).otherwise(0.0)
    ready = complete.join(moments, "ticker")
    g = gram(ready, ["ticker"], [F.lit(1.0), *[z(c, C(c)) for c in names], C("forward")]).drop("n")

    at = lambda i, j: F.get("gram", F.lit(i * p + j))
    own = [1 / prior_sd**2, *[1 / effect_sd**2] * len(names)]
    cells = []
    for i in range(p):
        for j in range(p):
            x = at(i, j) / C("v")
            if i == j == p - 1:
                x = F.lit(0.0)
            elif i == j:
                x = x + own[i]
            elif {i, j} == {0, p - 1}:
                x = x + prior_mean * own[0]
            cells.append(x)
    solved = today.join(moments, "ticker", "left").join(known, "ticker", "left").join(g, "ticker", "left")
    solved = solved.withColumn("m", F.when(C("outcomes") >= least_rows, swept_all(F.array(*cells), F.lit(p - 1), p)))
    now = [F.lit(1.0), *[F.coalesce(z(c, C(f"now_{c}")), F.lit(0.0)) for c in names]]
    effect = [F.get("m", F.lit(i * p + p - 1)) * x for i, x in enumerate(now)]
    spread = sum((-F.get("m", F.lit(i * p + j)) * now[i] * now[j] for i in range(p - 1) for j in range(p - 1)), F.lit(0.0))
    enough = C("m").isNotNull()
    return solved.select(
        "ticker",
        F.coalesce("outcomes", F.lit(0)).cast("long").alias("outcomes"),
        F.when(enough, sum(effect[1:], effect[0])).otherwise(prior_mean).alias("mean"),
        F.when(enough, F.sqrt(spread)).otherwise(prior_sd).alias("sd"),
        F.when(enough, effect[0]).otherwise(prior_mean).alias("baseline"),
        *[F.when(enough & C(f"in_{c}"), e).alias(c) for c, e in zip(names, effect[1:], strict=True)],
    )
