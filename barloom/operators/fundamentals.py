"""Fair value and market context (F1-F10, D17, D18), for all tickers at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col
REVENUE, NET = ("Total Revenue", "Operating Revenue"), ("Net Income", "Net Income Common Stockholders")
LOOKBACK, LEAST_QUARTERS, LEAST_HISTORY = 12, 4, 250
STRENGTH_DAYS, BETA_DAYS, LEAST_BETA = 63, 252, 60


def clean_earnings(raw: DataFrame) -> DataFrame:
    """One row for each ticker and time, the first of repeated ones (by ingest_seq if there)."""
    order = "ingest_seq" if "ingest_seq" in raw.columns else "reported_eps"
    w = Window.partitionBy("ticker", "announced_at").orderBy(order)
    typed = raw.where("announced_at IS NOT NULL").withColumn("__n", F.row_number().over(w)).where("__n = 1")
    return typed.select("ticker", C("announced_at").cast("timestamp").alias("announced_at"), *[C(c).cast("double").alias(c) for c in ("eps_estimate", "reported_eps", "surprise_pct")])


def standard_statement(wide: DataFrame, freq: str) -> DataFrame:
    """A statement with a column for each period in long form, newest first."""
    periods = [c for c in wide.columns if c not in ("ticker", "line_item")]
    long = wide.unpivot(["ticker", "line_item"], periods, "period", "value")
    return long.select("ticker", F.lit(freq).alias("freq"), "line_item", F.to_date("period").alias("period_end"), C("value").cast("double")).orderBy("ticker", "line_item", F.desc("period_end"))


def trailing_pe(bars: DataFrame, earnings: DataFrame, timezone: str) -> DataFrame:
    """close over the sum of the last four reported EPS, each effective from the exchange-local
    date of its announcement; rows where that sum is above 0. A backward as-of join by union and
    last value, one shuffle on ticker."""
    w = Window.partitionBy("ticker").orderBy("announced_at")
    reported = earnings.where("reported_eps IS NOT NULL")
    ttm = F.when(F.row_number().over(w) >= 4, F.sum("reported_eps").over(w.rowsBetween(-3, 0)))
    day = F.to_date(F.from_utc_timestamp("announced_at", timezone))
    sums = reported.select("ticker", day.alias("date"), "announced_at", ttm.alias("ttm")).where("ttm IS NOT NULL").groupBy("ticker", "date").agg(F.max_by("ttm", "announced_at").alias("ttm"))
    both = sums.select("ticker", "date", F.lit(0).alias("side"), "ttm", F.lit(None).cast("double").alias("close")).unionAll(bars.select("ticker", "date", F.lit(1), F.lit(None).cast("double"), "close"))
    known = both.withColumn("eps", F.last("ttm", ignorenulls=True).over(Window.partitionBy("ticker").orderBy("date", "side").rowsBetween(Window.unboundedPreceding, 0)))
    return known.where("side = 1 AND eps > 0").select("ticker", "date", (C("close") / C("eps")).alias("pe"))


def versus_history(pe: DataFrame) -> DataFrame:
    """F2: share of the history below today's; score from 1 (cheapest) to -1; null score under 250 days."""
    today = pe.groupBy("ticker").agg(F.max_by("pe", "date").alias("current"))
    g = pe.join(today, "ticker").groupBy("ticker").agg(F.count("pe").alias("days"), F.first("current").alias("current"), F.avg((C("pe") < C("current")).cast("double")).alias("share"), F.min("pe").alias("low"), F.max("pe").alias("high"), F.median("pe").alias("middle"))
    return g.withColumn("score", F.when(C("days") >= LEAST_HISTORY, -(2 * C("share") - 1)))


def plausible(value: Column, limit: Column) -> Column:
    """F3."""
    return value.isNotNull() & (value > 0) & (value <= limit)


def versus_peers(multiples: DataFrame, peers: DataFrame, settings: dict) -> DataFrame:
    """mean log ratio of own multiples to the peers' medians, over multiples where the own is
    plausible and so are two peers or more; peers that are implausibly high are listed."""
    limits = F.create_map(*[x for k, v in settings["plausible_multiple_max"].items() for x in (F.lit(k), F.lit(float(v)))])
    own = multiples.select("ticker", "multiple", C("value").alias("own"))
    others = peers.join(multiples.withColumnRenamed("ticker", "peer"), "peer").withColumn("limit", limits[C("multiple")])
    good = plausible(C("value"), C("limit"))
    each = others.groupBy("ticker", "multiple").agg(F.count_if(good).alias("n"), F.median(F.when(good, C("value"))).alias("middle"), F.sort_array(F.collect_list(F.when(C("value") > C("limit"), F.concat("peer", F.lit(" "), "multiple")))).alias("excluded"))
    joined = each.join(own, ["ticker", "multiple"], "left").withColumn("limit", limits[C("multiple")])
    usable = plausible(C("own"), C("limit")) & (C("n") >= 2)
    g = joined.groupBy("ticker").agg(F.avg(F.when(usable, F.ln(C("own") / C("middle")))).alias("ratio"), F.count_if(usable).alias("multiples"), F.sort_array(F.flatten(F.collect_list("excluded"))).alias("excluded"))
    return g.select("ticker", "multiples", "excluded", (-F.tanh(C("ratio") / settings["peer_log_ratio_scale"])).alias("score"))


def line(statement: DataFrame, freq: str, names: tuple[str, ...]) -> DataFrame:
    """Values of a line item by period; of aliases the first that the ticker has."""
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), C("line_item"))
    rows = statement.where((C("freq") == freq) & C("line_item").isin(*names))
    best = rows.groupBy("ticker").agg(F.min(rank).alias("rank"))
    return rows.withColumn("rank", rank).join(best, ["ticker", "rank"]).where("value IS NOT NULL").select("ticker", "period_end", "value")


def compound_growth(values: DataFrame) -> DataFrame:
    """yearly growth from the oldest to the newest value; null unless both are above 0."""
    g = values.groupBy("ticker").agg(F.min_by("value", "period_end").alias("a"), F.max_by("value", "period_end").alias("b"), (F.datediff(F.max("period_end"), F.min("period_end")) / 365.25).alias("years"))
    ratio = F.when((C("a") > 0) & (C("b") > 0) & (C("years") > 0), F.pow(C("b") / C("a"), 1 / C("years")) - 1)
    return g.select("ticker", ratio.alias("rate"))


def year_on_year(values: DataFrame) -> DataFrame:
    """Newest quarter over the one four before; null with fewer than five or a base of 0 or less."""
    w = Window.partitionBy("ticker").orderBy(F.desc("period_end"))
    g = values.withColumn("n", F.row_number().over(w)).groupBy("ticker").agg(F.max(F.when(C("n") == 1, C("value"))).alias("b"), F.max(F.when(C("n") == 5, C("value"))).alias("a"))
    return g.select("ticker", F.when(C("a") > 0, C("b") / F.nullif(C("a"), F.lit(0.0)) - 1).alias("rate"))


def growth_score(statement: DataFrame, scale: float) -> DataFrame:
    """mean tanh of the growth rates that are known; null if none is."""
    rates = compound_growth(line(statement, "annual", REVENUE)).unionAll(compound_growth(line(statement, "annual", NET))).unionAll(year_on_year(line(statement, "quarterly", REVENUE)))
    return rates.groupBy("ticker").agg(F.count("rate").alias("rates"), F.avg(F.tanh(C("rate") / scale)).alias("score"))


def surprise_score(earnings: DataFrame, scale: float) -> DataFrame:
    """of the last twelve complete reports, four at least: half the beat rate on -1..1, half
    tanh of the median surprise."""
    w = Window.partitionBy("ticker").orderBy(F.desc("announced_at"))
    rows = earnings.where("reported_eps IS NOT NULL AND eps_estimate IS NOT NULL AND surprise_pct IS NOT NULL").withColumn("n", F.row_number().over(w)).where(C("n") <= LOOKBACK)
    g = rows.groupBy("ticker").agg(F.count("n").alias("quarters"), F.avg((C("surprise_pct") > 0).cast("double")).alias("beats"), F.median("surprise_pct").alias("typical"))
    return g.withColumn("score", F.when(C("quarters") >= LEAST_QUARTERS, 0.5 * (2 * C("beats") - 1) + 0.5 * F.tanh(C("typical") / scale)))


def fair_value(scores: DataFrame, settings: dict) -> DataFrame:
    """F8: from (ticker, component, score) the weighted bias, label, confidence and drift tilt.
    Confidence is the share of weight that is known times the agreement of scores."""
    weights = settings["component_weights"]
    weight = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])[C("component")]
    known = C("score").isNotNull()
    g = scores.withColumn("w", weight).groupBy("ticker").agg(F.sum(F.when(known, C("w"))).alias("w"), F.sum(C("w") * C("score")).alias("ws"), F.count("score").alias("n"), F.max("score").alias("high"), F.min("score").alias("low"))
    bias = C("ws") / C("w")
    agreement = F.when(C("n") > 1, 1 - (C("high") - C("low")) / 2).otherwise(0.5)
    g = g.select("ticker", "n", bias.alias("raw"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), bias)).alias("bias"), (C("w") / sum(weights.values()) * agreement).alias("confidence"))
    band = settings["fair_value_band"]
    label = F.when(C("n") == 0, "not assessable").when(C("raw") > band, "undervalued").when(C("raw") < -band, "overvalued").otherwise("fairly valued")
    level = F.when(C("n") == 0, "none").when(C("confidence") >= 0.6, "high").when(C("confidence") >= 0.35, "medium").otherwise("low")
    return g.select("ticker", F.coalesce("bias", F.lit(0.0)).alias("bias"), label.alias("label"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), level.alias("confidence_label"), F.coalesce(C("bias") * settings["max_annual_tilt"] * C("confidence"), F.lit(0.0)).alias("annual_drift_tilt"))


def return_over(closes: DataFrame, days: int, by: list[str]) -> DataFrame:
    """last close over the one `days` rows before; null with fewer rows."""
    w = Window.partitionBy(*by).orderBy(F.desc("date"))
    g = closes.withColumn("n", F.row_number().over(w)).where(C("n").isin(1, days + 1)).groupBy(*by).agg(F.max(F.when(C("n") == 1, C("close"))).alias("b"), F.max(F.when(C("n") == days + 1, C("close"))).alias("a"))
    return g.select(*by, (C("b") / C("a") - 1).alias("ret"))


#: Index closes of this many rows or fewer are broadcast (a trading calendar has 250 a year).
CALENDAR_ROWS = 100_000


def index_strength(bars: DataFrame, index: DataFrame, name: str) -> DataFrame:
    """By ticker the index's return over 63 of its sessions up to the ticker's last date; `index` is
    (date, close), or (ticker, date, close) where tickers have indices of their own. An as-of join by
    union and a running last value."""
    own = "ticker" in index.columns
    by = ["ticker"] if own else []
    w = Window.partitionBy(*by).orderBy("date")
    ret = index.withColumn("ret", C("close") / F.lag("close", STRENGTH_DAYS).over(w) - 1).select(*by, "date", "ret", F.lit(True).alias("known"), F.lit(0).alias("side"))
    last = bars.groupBy("ticker").agg(F.max("date").alias("date"))
    if own:
        both = ret.unionByName(last.withColumn("side", F.lit(1)), allowMissingColumns=True)
        upto = Window.partitionBy("ticker").orderBy("date", "side").rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("held", F.last(F.when(C("known"), F.struct("ret")), ignorenulls=True).over(upto)).where("side = 1")
        return found.select("ticker", C("held.ret").alias(name))
    # One index for all: as-of for each distinct last date, of which there are no more than days.
    ends = ret.unionByName(last.select("date", F.lit(1).alias("side")).distinct(), allowMissingColumns=True)
    upto = Window.orderBy("date", "side").rowsBetween(Window.unboundedPreceding, 0)
    found = ends.withColumn("held", F.last(F.when(C("known"), F.struct("ret")), ignorenulls=True).over(upto)).where("side = 1").select("date", C("held.ret").alias(name))
    return last.join(found, "date").select("ticker", name)


def market_context(bars: DataFrame, benchmark: DataFrame, sector: DataFrame | None = None) -> DataFrame:
    """relative strength over 63 sessions against index closes (date, close), index history
    cut at the ticker's last date; beta and correlation of the last 252 common daily log returns
    (more than 60), differenced before the join; sector against benchmark without the cut. `sector`
    is one index (date, close) or one for each ticker (ticker, date, close); a ticker without one
    has nulls. Windows without a key run over one index's days alone."""
    days = lambda df: F.broadcast(df) if df.limit(CALENDAR_ROWS + 1).count() <= CALENDAR_ROWS else df
    own = return_over(bars, STRENGTH_DAYS, ["ticker"])
    out = own.select("ticker", C("ret").alias("own")).join(index_strength(bars, benchmark, "bench"), "ticker", "left")
    whole = return_over(benchmark.withColumn("k", F.lit(1)), STRENGTH_DAYS, ["k"]).select(C("ret").alias("b"))
    if sector is None:
        out = out.withColumns({"sect": F.lit(None).cast("double"), "sector_vs_benchmark": F.lit(None).cast("double")})
    else:
        out = out.join(index_strength(bars, sector, "sect"), "ticker", "left").crossJoin(F.broadcast(whole))  # one row
        if "ticker" in sector.columns:
            out = out.join(return_over(sector, STRENGTH_DAYS, ["ticker"]).withColumnRenamed("ret", "s"), "ticker", "left")
        else:
            out = out.crossJoin(F.broadcast(return_over(sector.withColumn("k", F.lit(1)), STRENGTH_DAYS, ["k"]).select(C("ret").alias("s"))))  # one row
        out = out.withColumn("sector_vs_benchmark", C("s") - C("b")).drop("s", "b")
    w = Window.partitionBy("ticker").orderBy("date")
    mine = bars.select("ticker", "date", (F.ln("close") - F.ln(F.lag("close").over(w))).alias("x"))
    theirs = benchmark.select("date", (F.ln("close") - F.ln(F.lag("close").over(Window.orderBy("date")))).alias("y"))
    joined = mine.join(days(theirs), "date").where("x IS NOT NULL AND y IS NOT NULL").withColumn("n", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).where(C("n") <= BETA_DAYS)
    pair = joined.groupBy("ticker").agg(F.count("x").alias("n"), (F.covar_samp("x", "y") / F.var_samp("y")).alias("beta"), F.corr("x", "y").alias("correlation"))
    enough = C("n") > LEAST_BETA
    out = out.join(pair, "ticker", "left")
    return out.select("ticker", (C("own") - C("bench")).alias("vs_benchmark"), (C("own") - C("sect")).alias("vs_sector"), "sector_vs_benchmark", F.when(enough, C("beta")).alias("beta"), F.when(enough, C("correlation")).alias("correlation"))
