"""Registered queries of the forecasting engine, one for each operator, and their SQL twins.

Both sides build the same fixture bars from lineitem; doubles are rounded to eight decimals.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import statistics as S
from .functions import windows as N
from .operators import clean, evaluate, filters, forecasts, fundamentals, indicators, posterior
from .plans import walkforward
from .plans.durable import durable
from .settings import load_settings
from .sources import files, fixtures

C = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SETTINGS = load_settings()
LEVELS = SETTINGS["forecast"]["interval_levels"]
HORIZON, FIRST = SETTINGS["forecast"]["horizon_days"], SETTINGS["walk_forward"]["min_training_days"]
STEP = SETTINGS["walk_forward"]["forecast_every_days"]
#: Paths of a stand-in forecast, and the turns by which its points go round: fractions of multiples of
#: the inverse powers of the plastic number, which cover a square evenly.
PATHS, TURNS = 1_000, (0.7548776662466927, 0.5698402909980532)
SCALES = {"gbm": 1.0, "garch_t": 0.9, "merton_jump": 1.1, "engine": 0.95}
GARCH = (0.05, 0.06, 0.08, 0.85)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to eight decimals, dates and times as text: the same in both engines."""
    as_text = ("date", "timestamp", "timestamp_ntz")
    return df.select(*[(F.round(c, 8) + F.lit(0.0)).alias(c) if t == "double" else C(f"`{c}`").cast("string").alias(c) if t in as_text else C(f"`{c}`") for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    """Registers a query, with its SQL if SQL can express it; doubles are rounded."""

    def wrap(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return wrap


def quantile_sql(q: float) -> str:
    """The linear quantile of a sorted list s."""
    whole = f"CAST(floor((len(s) - 1) * {q!r}) AS BIGINT)"
    return f"(s[{whole} + 1] + ((len(s) - 1) * {q!r} - {whole}) * (s[least({whole} + 2, len(s))] - s[{whole} + 1]))"


# ---- SQL fragments -------------------------------------------------------------------------

CTES: dict[str, str] = {
    "daily": "SELECT l_returnflag || l_linestatus AS ticker, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) AS p, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2",
    "zed": "SELECT *, (p - avg(p) OVER (PARTITION BY ticker)) / stddev_pop(p) OVER (PARTITION BY ticker) AS z FROM daily",
    "closes": "SELECT ticker, date, volume, round(100 * exp(sum(0.01 * z + 0.0003) OVER (PARTITION BY ticker ORDER BY date)), 4) AS close FROM zed",
    "opened": "SELECT *, coalesce(lag(close) OVER w, close) AS open, row_number() OVER w AS n FROM closes WINDOW w AS (PARTITION BY ticker ORDER BY date)",
    "bars": "SELECT ticker, date, open, round(greatest(open, close) * (1 + (n % 7 + 1) * 0.001) + 3e-8, 4) AS high, round(least(open, close) * (1 - (n % 5 + 1) * 0.001) + 3e-8, 4) AS low, close, volume FROM opened",
    "rets": "SELECT ticker, date, row_number() OVER w - 1 AS position, close, ln(close) AS x, ln(close) - lag(ln(close)) OVER w AS r FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)",
    "fits": f"SELECT *, avg(r) OVER w AS drift, stddev_samp(r) OVER w AS volatility, lead(x, {HORIZON}) OVER (PARTITION BY ticker ORDER BY date) - x AS realized, count(*) OVER (PARTITION BY ticker) AS n FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY date)",
    "origins": f"SELECT * FROM fits WHERE position >= {FIRST} AND (position - {FIRST}) % {STEP} = 0 AND position < n - {HORIZON}",
    "models": "SELECT * FROM (VALUES " + ", ".join(f"('{m}', {s})" for m, s in SCALES.items()) + ") AS t(model, scale)",
    "drawn": "SELECT ticker, date, position, model, realized, drift, volatility * scale AS sd, (CAST('0x' || substr(md5(name || '|u'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u, (CAST('0x' || substr(md5(name || '|v'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS v FROM (SELECT *, '42|' || ticker || '|' || position || '|' || model AS name FROM origins, models)",
    "paths": f"SELECT ticker, date, position, model, realized, list_sort(list_transform(range(1, {PATHS + 1}), lambda i: {HORIZON} * drift + sqrt({HORIZON}.0) * sd * sqrt(-2 * ln(1e-9 + (1 - 2e-9) * (u + i * {TURNS[0]!r} - floor(u + i * {TURNS[0]!r})))) * cos(2 * pi() * (v + i * {TURNS[1]!r} - floor(v + i * {TURNS[1]!r}))))) AS s FROM drawn",
    "samples": "SELECT ticker, date, position, model, realized, unnest(s) AS value FROM paths",
    "scored": "SELECT ticker, date, position, model, realized, list_sum(list_transform(s, lambda x: abs(x - realized))) / len(s) - list_sum(list_transform(s, lambda x, i: (2 * i - len(s) - 1) * x)) / (len(s) * len(s)) AS crps, list_sum(list_transform(s, lambda x: CASE WHEN x < realized THEN 1.0 WHEN x = realized THEN 0.5 ELSE 0.0 END)) / len(s) AS pit, len(list_filter(s, lambda x: x > 0)) / len(s) AS p_up, "
    + ", ".join(f"realized BETWEEN {quantile_sql((1 - v) / 2)} AND {quantile_sql(1 - (1 - v) / 2)} AS hit_{round(100 * v)}" for v in LEVELS)
    + " FROM paths",
    "records": "SELECT *, (p_up - CASE WHEN realized > 0 THEN 1.0 ELSE 0.0 END) ** 2 AS brier FROM scored",
    "beside": "SELECT r.*, b.crps AS b_crps, b.brier AS b_brier FROM records r JOIN records b ON r.ticker = b.ticker AND r.date = b.date AND b.model = 'gbm'",
    "regimes": "SELECT *, position % 3 = 0 AS earnings_in_window, CASE WHEN position % 50 < 25 THEN 0.7 ELSE 0.2 END AS turbulent_probability, CASE WHEN position % 4 = 0 THEN NULL ELSE CAST(position % 2 AS DOUBLE) END AS trending FROM beside",
    "quarters": "SELECT ticker, CAST(date_trunc('quarter', date) AS DATE) AS q, round(avg(close) / 10, 2) AS reported_eps FROM bars GROUP BY 1, 2",
    "earnings": "SELECT ticker, q + INTERVAL 3 MONTH + INTERVAL 14 DAY + CASE WHEN row_number() OVER w % 2 = 1 THEN INTERVAL 270 MINUTE ELSE INTERVAL 690 MINUTE END AS announced_at, lag(reported_eps) OVER w AS eps_estimate, reported_eps, round(100 * (reported_eps / lag(reported_eps) OVER w - 1), 4) AS surprise_pct FROM quarters WINDOW w AS (PARTITION BY ticker ORDER BY q)",
    "reactions": "SELECT DISTINCT ticker, (SELECT min(b.date) FROM bars b WHERE b.ticker = e.ticker AND b.date >= e.day) AS date FROM (SELECT ticker, CAST(announced_at + INTERVAL 330 MINUTE AS DATE) + CASE WHEN hour(announced_at + INTERVAL 330 MINUTE) * 60 + minute(announced_at + INTERVAL 330 MINUTE) >= 930 THEN 1 ELSE 0 END AS day FROM earnings) e",
    "reacting": "SELECT * FROM reactions WHERE date IS NOT NULL",
    "pes": "SELECT b.ticker, b.date, b.close / t.ttm AS pe FROM bars b ASOF JOIN (SELECT ticker, day, max_by(ttm, announced_at) AS ttm FROM (SELECT ticker, announced_at, CAST(announced_at + INTERVAL 330 MINUTE AS DATE) AS day, CASE WHEN row_number() OVER w >= 4 THEN sum(reported_eps) OVER (PARTITION BY ticker ORDER BY announced_at ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END AS ttm FROM earnings WINDOW w AS (PARTITION BY ticker ORDER BY announced_at)) WHERE ttm IS NOT NULL GROUP BY 1, 2) t ON b.ticker = t.ticker AND b.date >= t.day WHERE t.ttm > 0",
    "periods": "SELECT ticker, 'annual' AS freq, CAST(date_trunc('year', date) + INTERVAL 12 MONTH - INTERVAL 1 DAY AS DATE) AS period_end, round(sum(close * volume), 2) AS revenue, sum(volume) AS v FROM bars GROUP BY 1, 3 UNION ALL SELECT ticker, 'quarterly', CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE), round(sum(close * volume), 2), sum(volume) FROM bars GROUP BY 1, 3",
    "statements": "SELECT ticker, freq, 'Total Revenue' AS line_item, period_end, revenue AS value FROM periods UNION ALL SELECT ticker, freq, 'Net Income', period_end, round(revenue * 0.1 - v * 0.1, 2) FROM periods",
    "lastbar": "SELECT ticker, max_by(close, date) AS c, max_by(volume, date) AS v FROM bars GROUP BY 1",
    "multiples": "SELECT ticker, 'trailingPE' AS multiple, round(10 + c % 30, 2) AS value FROM lastbar UNION ALL SELECT ticker, 'priceToBook', round(1 + v % 9, 2) FROM lastbar UNION ALL SELECT ticker, 'enterpriseToEbitda', CASE WHEN ticker = 'AO' THEN 900.0 ELSE round(5 + c % 20, 2) END FROM lastbar",
    "growths": "SELECT ticker, line_item, CASE WHEN min_by(value, period_end) > 0 AND max_by(value, period_end) > 0 THEN (max_by(value, period_end) / min_by(value, period_end)) ** (1 / (date_diff('day', min(period_end), max(period_end)) / 365.25)) - 1 END AS rate FROM statements WHERE freq = 'annual' GROUP BY 1, 2 UNION ALL SELECT ticker, 'yoy', max(value) FILTER (k = 1) / max(value) FILTER (k = 5) - 1 FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period_end DESC) AS k FROM statements WHERE freq = 'quarterly' AND line_item = 'Total Revenue') GROUP BY 1",
    "surprises": "SELECT ticker, count(*) AS quarters, avg(CASE WHEN surprise_pct > 0 THEN 1.0 ELSE 0.0 END) AS beats, median(surprise_pct) AS typical FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY announced_at DESC) AS k FROM earnings WHERE eps_estimate IS NOT NULL AND surprise_pct IS NOT NULL) WHERE k <= 12 GROUP BY 1",
    "history": "SELECT p.ticker, count(*) AS days, any_value(t.current) AS current, avg(CASE WHEN pe < t.current THEN 1.0 ELSE 0.0 END) AS share, min(pe) AS low, max(pe) AS high, median(pe) AS middle FROM pes p JOIN (SELECT ticker, max_by(pe, date) AS current FROM pes GROUP BY 1) t ON p.ticker = t.ticker GROUP BY 1",
    "peers": "SELECT a.ticker, b.ticker AS peer FROM lastbar a JOIN lastbar b ON a.ticker <> b.ticker",
    "limits": "SELECT * FROM (VALUES ('trailingPE', 200.0), ('priceToBook', 50.0), ('enterpriseToEbitda', 100.0)) AS t(multiple, most)",
    "peered": "SELECT p.ticker, m.multiple, any_value(l.most) AS most, count(*) FILTER (m.value > 0 AND m.value <= l.most) AS n, median(m.value) FILTER (m.value > 0 AND m.value <= l.most) AS middle, list(p.peer || ' ' || m.multiple) FILTER (m.value > l.most) AS excluded FROM peers p JOIN multiples m ON m.ticker = p.peer JOIN limits l ON l.multiple = m.multiple GROUP BY 1, 2",
    "versus": "SELECT p.ticker, count(*) FILTER (m.value > 0 AND m.value <= p.most AND p.n >= 2) AS multiples, coalesce(list_sort(flatten(list(p.excluded) FILTER (p.excluded IS NOT NULL))), []) AS excluded, -tanh(avg(ln(m.value / p.middle)) FILTER (m.value > 0 AND m.value <= p.most AND p.n >= 2) / 0.5) AS score FROM peered p JOIN multiples m ON m.ticker = p.ticker AND m.multiple = p.multiple GROUP BY 1",
    "ndaily": "SELECT CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) AS p FROM lineitem GROUP BY 1",
    "nz": "SELECT *, (p - avg(p) OVER ()) / stddev_pop(p) OVER () AS z FROM ndaily",
    "index_closes": "SELECT date, round(100 * exp(sum(0.01 * z + 0.0003) OVER (ORDER BY date)), 4) AS close FROM nz",
}


def sql(final: str, **more: str) -> str:
    """A statement with the fragments it needs before it, in order; `more` adds fragments."""
    need: set[str] = set()

    def visit(text: str) -> None:
        for k, body in CTES.items():
            if k not in need and k in _words(text):
                need.add(k)
                visit(body)

    for text in (final, *more.values()):
        visit(text)
    head = final.split(" FROM ")[0]
    named_dates = {x.strip().split()[-1].split(".")[-1] for x in head.split(",")} & {"date", "period_end", "announced_at"} or ({"SELECT * FROM bars": {"date"}, "SELECT * FROM statements": {"period_end"}}).get(final, set())
    if named_dates:
        final = "SELECT * REPLACE (" + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in sorted(named_dates)) + f") FROM ({final})"
    parts = [f"{k} AS ({CTES[k]})" for k in CTES if k in need] + [f"{k} AS ({v})" for k, v in more.items()]
    return ("WITH RECURSIVE " if any("UNION ALL SELECT" in v and f"FROM {k}" in v for k, v in more.items()) else "WITH ") + ", ".join(parts) + " " + final


def _words(text: str) -> set[str]:
    out, word = set(), ""
    for ch in text + " ":
        if ch.isalnum() or ch == "_":
            word += ch
        else:
            out.add(word)
            word = ""
    return out


def r8(*columns: str) -> str:
    named = [c.rsplit(" AS ", 1) if c.rfind(" AS ") > c.rfind(")") else [c, c] for c in columns]
    return ", ".join(f"round({a}, 8) + 0.0 AS {b}" for a, b in named)


W = "(PARTITION BY ticker ORDER BY date)"


def last(n: int) -> str:
    return f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(aggregate: str, x: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN count({x}) OVER {last(n)} >= {least or n} THEN {aggregate}({x}) OVER {last(n)} END"


def ewm_sql(source: str, x: str, alpha: str, name: str, least: int = 0) -> str:
    """Adds an exponential average to a fragment by one scaled running sum."""
    inner = f"SELECT *, CASE WHEN {x} IS NOT NULL THEN count({x}) OVER {W} - 1 END AS {name}_n FROM ({source})"
    return f"SELECT *, CASE WHEN {name}_n >= {max(least, 1) - 1} THEN pow(1 - {alpha}, {name}_n) * sum(CASE WHEN {name}_n = 0 THEN 1 ELSE {alpha} END * {x} * pow(1 - {alpha}, -{name}_n)) OVER {W} END AS {name} FROM ({inner})"


def std_norm(x: str) -> str:
    return f"tanh({x} / nullif({roll('stddev_samp', x, 252, 126)}, 0))"


def clip(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(-1.0, least(1.0, {x})) END"


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.walk_bars(spark, sf_dir)


# ---- fixtures and cleaning -------------------------------------------------------------------

query("src_walk_bars", sql("SELECT * FROM bars"))(bars)

LINE = "SELECT l_returnflag || l_linestatus AS ticker, CAST(l_shipdate AS DATE) AS date, round(l_extendedprice / l_quantity + 3e-8, 4) AS price, l_quantity AS q, row_number() OVER (PARTITION BY l_returnflag, l_linestatus, l_shipdate ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem"
query("src_line_bars", sql("SELECT ticker, date, min_by(price, k) AS open, max(price) AS high, min(price) AS low, max_by(price, k) AS close, sum(q) AS volume FROM trades GROUP BY 1, 2", trades=LINE))(fixtures.line_bars)


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with repeated days, missing volumes, flat days without volume and highs slightly low."""
    w = Window.partitionBy("ticker").orderBy("date")
    b = bars(spark, sf_dir).withColumn("n", F.row_number().over(w))
    body = F.greatest("open", "close")
    b = b.withColumns({"high": F.when(C("n") % 11 == 0, body * 0.999).otherwise(C("high")), "volume": F.when(C("n") % 13 == 0, F.lit(None)).otherwise(C("volume"))})
    flat = b.where("n % 17 = 0").withColumns({"date": F.date_add("date", 5000), **{c: C("close") for c in clean.PRICES}, "volume": F.lit(0.0)})
    again = b.where("n % 19 = 0").withColumns({"close": C("close") * 1.001, "high": F.round(C("high") * 1.01 + 3e-8, 4)})
    one = lambda df, k: df.withColumn("ingest_seq", C("n") * 10 + k)
    return one(b, 0).unionByName(one(flat, 1)).unionByName(one(again, 2)).drop("n").withColumnsRenamed({"open": "Open", "close": "CLOSE", "date": "Date"})


CTES["dirty"] = (
    "SELECT * FROM (SELECT ticker, date, open, CASE WHEN n % 11 = 0 THEN greatest(open, close) * 0.999 ELSE high END AS high, low, close, CASE WHEN n % 13 = 0 THEN NULL ELSE volume END AS volume, n * 10 AS s, n FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM bars)) "
)
CTES["raw"] = "SELECT ticker, date, open, high, low, close, volume, s FROM dirty UNION ALL SELECT ticker, date + 5000, close, close, close, close, 0.0, n * 10 + 1 FROM dirty WHERE n % 17 = 0 UNION ALL SELECT ticker, date, open, round(high * 1.01 + 3e-8, 4), low, close * 1.001, volume, n * 10 + 2 FROM dirty WHERE n % 19 = 0"
CTES["deduped"] = "SELECT ticker, date, max_by(open, s) AS open, max_by(high, s) AS high, max_by(low, s) AS low, max_by(close, s) AS close, arg_max_null(volume, s) AS volume FROM raw GROUP BY 1, 2"
CTES["whole"] = "SELECT * FROM deduped WHERE volume IS NOT NULL"
CTES["mended"] = "SELECT ticker, date, open, greatest(high, open, close) AS high, least(low, open, close) AS low, close, volume FROM whole"
BAR8 = r8("open", "high", "low", "close", "volume")

query("clean_dedupe_last", sql(f"SELECT ticker, date, {BAR8} FROM deduped"))(lambda s, d: clean.last_of_each_day(clean.renamed(dirty(s, d))))
query("clean_complete", sql(f"SELECT ticker, date, {BAR8} FROM whole"))(lambda s, d: clean.complete(clean.last_of_each_day(clean.renamed(dirty(s, d)))))
query("clean_standardise", sql(f"SELECT ticker, date, {BAR8} FROM mended"))(lambda s, d: clean.standardise(dirty(s, d), 0.02))
query("clean_drop_placeholders", sql(f"SELECT ticker, date, {BAR8} FROM mended WHERE NOT (open = high AND high = low AND low = close AND volume = 0)"))(lambda s, d: clean.drop_placeholders(clean.standardise(dirty(s, d), 0.02)))
query("clean_problems", sql("SELECT r.ticker, count(*) AS rows, count(*) FILTER (volume IS NULL) AS missing_values, 0::BIGINT AS prices_not_positive, count(*) FILTER (volume < 0) AS negative_volume, count(*) FILTER (high < greatest(open, close) OR low > least(open, close)) AS body_outside_range, any_value(d.n) AS repeated_dates FROM raw r JOIN (SELECT ticker, CAST(sum(c - 1) AS BIGINT) AS n FROM (SELECT ticker, date, count(*) AS c FROM raw GROUP BY 1, 2) GROUP BY 1) d ON d.ticker = r.ticker GROUP BY 1"))(lambda s, d: clean.problems(clean.renamed(dirty(s, d))))
NOW = datetime(1999, 6, 30, 20, 0)
query("clean_drop_unfinished", sql(f"SELECT ticker, date, {BAR8} FROM bars WHERE date < DATE '1999-07-01'"))(lambda s, d: clean.drop_unfinished(bars(s, d), NOW, "Asia/Kolkata"))
query("clean_trim_history", sql(f"SELECT ticker, date, {BAR8} FROM bars WHERE date >= DATE '1997-06-30'"))(lambda s, d: clean.trim_history(bars(s, d), NOW, 2))
query("clean_history_spans", sql(f"SELECT ticker, {r8('date_diff(' + chr(39) + 'day' + chr(39) + ', min(date), max(date)) / 365.25 AS years')} FROM bars GROUP BY 1"))(lambda s, d: clean.spans(bars(s, d)))
query("clean_load_bars", sql(f"SELECT ticker, date, {BAR8} FROM mended WHERE NOT (open = high AND high = low AND low = close AND volume = 0) AND date >= DATE '1991-12-31'"))(lambda s, d: clean.load_bars(dirty(s, d), load_settings(data={"ohlc_repair_tolerance": 0.02}), datetime(2001, 12, 31)))
query("clean_earnings", sql("SELECT ticker, announced_at, eps_estimate, reported_eps, surprise_pct FROM earnings"))(lambda s, d: fundamentals.clean_earnings(fixtures.announcements(bars(s, d)).unionAll(fixtures.announcements(bars(s, d)).withColumn("reported_eps", C("reported_eps") + 1))))


def _standardised(s: SparkSession, d: str) -> DataFrame:
    """Statements as a source has them, a column for each period, brought back to the long form."""
    long = fixtures.statements(bars(s, d)).withColumn("period_end", C("period_end").cast("string"))
    wide = lambda freq: long.where(C("freq") == freq).groupBy("ticker", "line_item").pivot("period_end").agg(F.first("value"))
    both = [fundamentals.standard_statement(wide(freq), freq) for freq in ("annual", "quarterly")]
    return both[0].unionByName(both[1]).where("value IS NOT NULL")


query("clean_statements", sql("SELECT * FROM statements"))(_standardised)
query("src_fundamentals_json", sql("SELECT * FROM statements"))(lambda s, d: files.from_json(files.to_json(fixtures.statements(bars(s, d))), "statements"))
query("clean_cache_names", "SELECT DISTINCT regexp_replace(p_name || '&/' || p_brand, '[^A-Za-z0-9._^-]', '_', 'g') || '_1d.csv' AS file FROM part")(lambda s, d: s.read.parquet(f"{d}/part.parquet").select(F.concat(F.regexp_replace(F.concat("p_name", F.lit("&/"), "p_brand"), "[^A-Za-z0-9._^-]", "_"), F.lit("_1d.csv")).alias("file")).distinct())


# ---- indicators and normalisation --------------------------------------------------------------

TR = f"greatest(high - low, abs(high - lag(close) OVER {W}), abs(low - lag(close) OVER {W}))"
TP = "(high + low + close) / 3"
PCT = "CASE WHEN raw IS NOT NULL AND n >= 126 THEN 2 * (len(list_filter(held, lambda v: v < raw)) + 0.5 * (len(list_filter(held, lambda v: v = raw)) - 1)) / nullif(rows - 1, 0) - 1 END"


NORMAL: list[str] = []


def indicator_sql(source: str, normal: str, percentile: bool = False) -> str:
    if percentile:
        source = f"SELECT *, list(raw) FILTER (raw IS NOT NULL) OVER {last(252)} AS held, count(*) OVER {last(252)} AS rows, count(raw) OVER {last(252)} AS n FROM ({source})"
    NORMAL.append(f"SELECT ticker, date, {normal} AS normal FROM ({source})")
    return sql(f"SELECT ticker, date, {r8('raw', normal + ' AS normal')} FROM ({source})")


DI = f"SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END AS pdm, CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END AS mdm FROM (SELECT *, {TR} AS tr, high - lag(high) OVER {W} AS up, -(low - lag(low) OVER {W}) AS down FROM bars)"
DI = ewm_sql(ewm_sql(ewm_sql(DI, "tr", "(1.0/14)", "atr", 14), "pdm", "(1.0/14)", "ap", 14), "mdm", "(1.0/14)", "am", 14)
DI = f"SELECT *, 100 * ap / nullif(atr, 0) AS pdi, 100 * am / nullif(atr, 0) AS mdi FROM ({DI})"
ADX = ewm_sql(f"SELECT *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM ({DI})", "dx", "(1.0/14)", "raw", 14)
MACD = ewm_sql(ewm_sql(ewm_sql("SELECT * FROM bars", "close", "(2.0/13)", "f"), "close", "(2.0/27)", "s"), "(f - s)", "(2.0/10)", "sig")
RSI = ewm_sql(ewm_sql(f"SELECT *, greatest(m, 0.0 * m) AS gain, greatest(-m, 0.0 * m) AS loss FROM (SELECT *, close - lag(close) OVER {W} AS m FROM bars)", "gain", "(1.0/14)", "g", 14), "loss", "(1.0/14)", "l", 14)
INDICATOR_SQL = {
    "moving_average_spread": indicator_sql(f"SELECT *, f / {'(' + roll('avg', 'close', 50) + ')'} - 1 AS raw FROM ({ewm_sql('SELECT * FROM bars', 'close', '(2.0/21)', 'f', 20)})", std_norm("raw")),
    "macd": indicator_sql(f"SELECT *, CASE WHEN row_number() OVER {W} - 1 >= 35 THEN (f - s - sig) / close END AS raw FROM ({MACD})", std_norm("raw")),
    "directional_movement": indicator_sql(f"SELECT *, (pdi - mdi) / nullif(pdi + mdi, 0) AS raw FROM ({DI})", clip("raw")),
    "adx": indicator_sql(ADX, clip("((raw - 25) / 25)")),
    "rsi": indicator_sql(f"SELECT *, CASE WHEN l > 0 THEN 100 - 100 / (1 + g / nullif(l, 0)) WHEN l = 0 AND g > 0 THEN 100.0 END AS raw FROM ({RSI})", clip("((raw - 50) / 50)")),
    "stochastic": indicator_sql(f"SELECT *, {roll('avg', 'k', 3)} AS raw FROM (SELECT *, 100 * (close - lo) / nullif(hi - lo, 0) AS k FROM (SELECT *, {roll('min', 'low', 14)} AS lo, {roll('max', 'high', 14)} AS hi FROM bars))", clip("((raw - 50) / 50)")),
    "cci": indicator_sql(f"SELECT *, (tp - m) / nullif(0.015 * list_sum(list_transform(held, lambda v: abs(v - m))) / 20, 0) AS raw FROM (SELECT *, {roll('avg', 'tp', 20)} AS m, list(tp) OVER {last(20)} AS held FROM (SELECT *, {TP} AS tp FROM bars))", "tanh(raw / 100)"),
    "bollinger_position": indicator_sql(f"SELECT *, (close - ({roll('avg', 'close', 20)})) / nullif(2.0 * ({roll('stddev_pop', 'close', 20)}), 0) AS raw FROM bars", clip("raw")),
    "atr_percent": indicator_sql(f"SELECT *, atr / close AS raw FROM ({ewm_sql(f'SELECT *, {TR} AS tr FROM bars', 'tr', '(1.0/14)', 'atr', 14)})", PCT, True),
    "bollinger_bandwidth": indicator_sql(f"SELECT *, 4.0 * ({roll('stddev_pop', 'close', 20)}) / ({roll('avg', 'close', 20)}) AS raw FROM bars", PCT, True),
    "realized_volatility": indicator_sql(f"SELECT *, {roll('stddev_samp', 'r', 21)} AS raw FROM rets", PCT, True),
    "obv_slope": indicator_sql(f"SELECT *, (obv - lag(obv, 20) OVER {W}) / nullif(20 * ({roll('avg', 'volume', 20)}), 0) AS raw FROM (SELECT *, sum(flow) OVER {W} AS obv FROM (SELECT *, coalesce(sign(close - lag(close) OVER {W}) * volume, 0.0) AS flow FROM bars))", std_norm("raw")),
    "vwap_distance": indicator_sql(f"SELECT *, close / nullif(({roll('sum', 'tv', 20)}) / nullif({roll('sum', 'volume', 20)}, 0), 0) - 1 AS raw FROM (SELECT *, {TP} * volume AS tv FROM bars)", std_norm("raw")),
    "chaikin_money_flow": indicator_sql(f"SELECT *, ({roll('sum', 'mf', 20)}) / nullif({roll('sum', 'volume', 20)}, 0) AS raw FROM (SELECT *, coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0.0) * volume AS mf FROM bars)", std_norm("raw")),
}
for _name in indicators.REGISTRY:
    query(f"ind_{_name}", INDICATOR_SQL[_name])(lambda s, d, n=_name: indicators.compute(bars(s, d), n, SETTINGS))
query("ind_true_range", sql(f"SELECT ticker, date, {r8(TR + ' AS tr')} FROM bars"))(lambda s, d: bars(s, d).select("ticker", "date", indicators.true_range().alias("tr")))
query("ind_wilder_average", sql(f"SELECT ticker, date, {r8('y')} FROM ({ewm_sql('SELECT * FROM bars', 'close', '(1.0/14)', 'y', 14)})"))(lambda s, d: N.wilder(bars(s, d), C("close"), 14, "y").select("ticker", "date", "y"))
query("ind_wilder_average_50", sql(f"SELECT ticker, date, {r8('y')} FROM ({ewm_sql('SELECT * FROM bars', 'close', '(1.0/50)', 'y', 50)})"))(lambda s, d: N.wilder(bars(s, d), C("close"), 50, "y").select("ticker", "date", "y"))
query("ind_directional_lines", sql(f"SELECT ticker, date, {r8('pdi AS plus_di', 'mdi AS minus_di')} FROM ({DI})"))(lambda s, d: indicators.directional(bars(s, d), 14).select("ticker", "date", "plus_di", "minus_di"))


def joined_sql(names: list[str]) -> str:
    """All bars with the normal values of the named indicators."""
    of = {n: NORMAL[list(INDICATOR_SQL).index(n)] for n in names}
    return "SELECT a.ticker, a.date, " + ", ".join(f"t{k}.normal AS {n}" for k, n in enumerate(names)) + " FROM bars a " + " ".join(f"JOIN ({of[n]}) t{k} ON t{k}.ticker = a.ticker AND t{k}.date = a.date" for k, n in enumerate(names))


EVERY = list(indicators.REGISTRY)
query("ind_all_normalised", sql(f"SELECT j.ticker, j.date, {r8(*[f'b.{n} AS {n}' for n in ('open', 'high', 'low', 'close', 'volume')], *[f'j.{n} AS {n}' for n in EVERY], 'x.raw AS adx_raw')} FROM ({joined_sql(EVERY)}) j JOIN bars b ON b.ticker = j.ticker AND b.date = j.date JOIN ({ADX}) x ON x.ticker = j.ticker AND x.date = j.date"))(lambda s, d: indicators.compute_all(bars(s, d), SETTINGS))
query("norm_bounded", sql(f"SELECT ticker, date, {r8(clip('((close - 100) / 50)') + ' AS y')} FROM bars"))(lambda s, d: bars(s, d).select("ticker", "date", N.bounded(C("close"), 100.0, 50.0).alias("y")))
query("norm_trailing_std", sql(f"SELECT ticker, date, {r8(std_norm('r') + ' AS y')} FROM rets"))(lambda s, d: forecasts.log_returns(bars(s, d)).select("ticker", "date", N.by_trailing_std(C("r"), 252).alias("y")))
query("norm_tanh", sql(f"SELECT ticker, date, {r8('tanh(r / 0.02) AS y')} FROM rets"))(lambda s, d: forecasts.log_returns(bars(s, d)).select("ticker", "date", N.tanh_scaled(C("r"), 0.02).alias("y")))
query("norm_trailing_percentile", sql(f"SELECT ticker, date, {r8(PCT + ' AS y')} FROM (SELECT *, list(raw) FILTER (raw IS NOT NULL) OVER {last(252)} AS held, count(*) OVER {last(252)} AS rows, count(raw) OVER {last(252)} AS n FROM (SELECT *, r AS raw FROM rets))"))(lambda s, d: forecasts.log_returns(bars(s, d)).select("ticker", "date", N.trailing_percentile(C("r"), 252).alias("y")))

PRIORITY = SETTINGS["redundancy"]["priority"]


def normals(s: SparkSession, d: str) -> DataFrame:
    return indicators.compute_all(bars(s, d), SETTINGS, PRIORITY)


PAIRS = [(a, b) for i, a in enumerate(PRIORITY) for b in PRIORITY[i + 1 :]]
RHO = {
    "normal_values": joined_sql(PRIORITY),
    "wide_rho": "SELECT ticker, " + ", ".join(f"corr({a}, {b}) AS r{k}" for k, (a, b) in enumerate(PAIRS)) + f" FROM normal_values WHERE {' AND '.join(f'{n} IS NOT NULL' for n in PRIORITY)} GROUP BY 1",
    "rho": "SELECT ticker, unnest([" + ", ".join(f"{{'a': '{a}', 'b': '{b}', 'rho': r{k}}}" for k, (a, b) in enumerate(PAIRS)) + "], recursive := true) FROM wide_rho",
}
query("agg_correlations", sql("SELECT ticker, a, b, round(rho, 6) + 0.0 AS rho FROM rho", **RHO))(lambda s, d: indicators.correlations(normals(s, d), PRIORITY).withColumn("rho", F.round("rho", 6)))
# The greedy choice, one name at a time: a name is kept unless one that is kept correlates too much.
KEPT = RHO | {
    "close_pairs": f"SELECT ticker, list(a || '|' || b) FILTER (abs(rho) > {SETTINGS['redundancy']['max_abs_correlation']}) AS near FROM rho GROUP BY 1",
    "names": "SELECT unnest(range(1, " + str(len(PRIORITY) + 1) + ")) AS i, unnest([" + ", ".join(f"'{n}'" for n in PRIORITY) + "]) AS name",
    "choice": "SELECT ticker, near, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS kept FROM close_pairs UNION ALL SELECT c.ticker, c.near, n.i, CASE WHEN len(list_filter(c.kept, lambda k: list_contains(c.near, k || '|' || n.name))) = 0 THEN list_append(c.kept, n.name) ELSE c.kept END FROM choice c JOIN names n ON n.i = c.i + 1",
}
query("agg_redundancy", sql(f"SELECT ticker, array_to_string(kept, ',') AS kept, {len(PRIORITY)} - len(kept) AS dropped FROM choice WHERE i = {len(PRIORITY)}", **KEPT))(lambda s, d: indicators.pruned(normals(s, d), SETTINGS).select("ticker", F.array_join("kept", ",").alias("kept"), F.size("dropped").cast("long").alias("dropped")))
query("agg_redundancy_twins")(lambda s, d: indicators.pruned(normals(s, d), SETTINGS))
MEMBERS = {c: [n for n in PRIORITY if indicators.categories()[n] == c] for c in ("trend", "momentum", "volatility", "volume")}
query("agg_composites", sql(f"SELECT ticker, date, {r8(*['(' + ' + '.join(ns) + f') / {len(ns)} AS {c}' for c, ns in MEMBERS.items()])} FROM normal_values", normal_values=RHO["normal_values"]))(lambda s, d: indicators.composites(normals(s, d).drop("volume"), PRIORITY, SETTINGS).select("ticker", "date", *MEMBERS))
query("agg_is_trending", sql(f"SELECT ticker, date, CASE WHEN raw IS NOT NULL THEN CASE WHEN raw > 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS trending FROM ({ADX})"))(lambda s, d: indicators.adx(bars(s, d), SETTINGS).select("ticker", "date", indicators.is_trending(C("adx"), 25).alias("trending")))


# ---- fundamentals --------------------------------------------------------------------------

FUND = SETTINGS["fundamentals"]


def earnings(s: SparkSession, d: str) -> DataFrame:
    return fixtures.announcements(bars(s, d))


def all_pairs(s: SparkSession, d: str) -> DataFrame:
    """Peers: every other ticker (a fixture of a few tickers)."""
    t = bars(s, d).select("ticker").distinct()
    return t.join(F.broadcast(t.withColumnRenamed("ticker", "peer")), C("ticker") != C("peer"))


def index_closes(s: SparkSession, d: str) -> DataFrame:
    return fixtures.walk_bars(s, d, whole=True).select("date", "close")


def scores(s: SparkSession, d: str) -> DataFrame:
    pe = fundamentals.versus_history(fundamentals.trailing_pe(bars(s, d), earnings(s, d), "Asia/Kolkata"))
    peers = fundamentals.versus_peers(fixtures.multiples(bars(s, d)), all_pairs(s, d), FUND)
    growth = fundamentals.growth_score(fixtures.statements(bars(s, d)), FUND["growth_scale"])
    surprise = fundamentals.surprise_score(earnings(s, d), FUND["surprise_scale_pct"])
    named = lambda df, n: df.select("ticker", F.lit(n).alias("component"), "score")
    return named(pe, "valuation_vs_history").unionAll(named(peers, "valuation_vs_peers")).unionAll(named(growth, "growth")).unionAll(named(surprise, "earnings_surprise"))


SURPRISE = "CASE WHEN quarters >= 4 THEN 0.5 * (2 * beats - 1) + 0.5 * tanh(typical / 5.0) END"
GROWTH = "SELECT ticker, count(rate) AS rates, avg(tanh(rate / 0.15)) AS score FROM growths GROUP BY 1"
CTES["scored_parts"] = f"SELECT ticker, 0.3 AS w, CASE WHEN days >= 250 THEN -(2 * share - 1) END AS score FROM history UNION ALL SELECT ticker, 0.3, score FROM versus UNION ALL SELECT ticker, 0.2, score FROM ({GROWTH}) UNION ALL SELECT ticker, 0.2, {SURPRISE} FROM surprises"
CTES["summed"] = "SELECT ticker, sum(w) FILTER (score IS NOT NULL) AS w, sum(w * score) AS ws, count(score) AS n, max(score) AS hi, min(score) AS lo FROM scored_parts GROUP BY 1"
CTES["assessed"] = "SELECT ticker, n, ws / w AS raw, greatest(-1.0, least(1.0, ws / w)) AS bias, w / 1.0 * CASE WHEN n > 1 THEN 1 - (hi - lo) / 2 ELSE 0.5 END AS confidence FROM summed"
query("fund_trailing_pe", sql(f"SELECT ticker, date, {r8('pe')} FROM pes"))(lambda s, d: fundamentals.trailing_pe(bars(s, d), earnings(s, d), "Asia/Kolkata"))
query("fund_versus_history", sql(f"SELECT ticker, days, {r8('current', 'share', 'low', 'high', 'middle', 'CASE WHEN days >= 250 THEN -(2 * share - 1) END AS score')} FROM history"))(lambda s, d: fundamentals.versus_history(fundamentals.trailing_pe(bars(s, d), earnings(s, d), "Asia/Kolkata")))
query("fund_versus_peers", sql(f"SELECT ticker, multiples, array_to_string(excluded, ',') AS excluded, {r8('score')} FROM versus"))(lambda s, d: fundamentals.versus_peers(fixtures.multiples(bars(s, d)), all_pairs(s, d), FUND).withColumn("excluded", F.array_join("excluded", ",")))
query("fund_compound_growth", sql(f"SELECT ticker, {r8('rate')} FROM growths WHERE line_item = 'Total Revenue'"))(lambda s, d: fundamentals.compound_growth(fundamentals.line(fixtures.statements(bars(s, d)), "annual", fundamentals.REVENUE)))
query("fund_growth_score", sql(f"SELECT ticker, rates, {r8('score')} FROM ({GROWTH})"))(lambda s, d: fundamentals.growth_score(fixtures.statements(bars(s, d)), 0.15))
query("fund_surprise_score", sql(f"SELECT ticker, quarters, {r8('beats', 'typical', SURPRISE + ' AS score')} FROM surprises"))(lambda s, d: fundamentals.surprise_score(earnings(s, d), 5.0))
query("fund_fair_value", sql(f"SELECT ticker, {r8('bias')}, CASE WHEN raw > 0.2 THEN 'undervalued' WHEN raw < -0.2 THEN 'overvalued' ELSE 'fairly valued' END AS label, {r8('confidence')}, CASE WHEN confidence >= 0.6 THEN 'high' WHEN confidence >= 0.35 THEN 'medium' ELSE 'low' END AS confidence_label, {r8('bias * 0.03 * confidence AS annual_drift_tilt')} FROM assessed"))(lambda s, d: fundamentals.fair_value(scores(s, d), FUND))
query("fund_return_over", sql(f"SELECT ticker, {r8('max(close) FILTER (k = 1) / max(close) FILTER (k = 64) - 1 AS ret')} FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars) GROUP BY 1"))(lambda s, d: fundamentals.return_over(bars(s, d), 63, ["ticker"]))
SECTOR = "SELECT date, close FROM bars WHERE ticker = 'NO'"
query(
    "fund_market_context",
    sql(
        "SELECT o.ticker, round(o.own - b.ret, 8) + 0.0 AS vs_benchmark, round(o.own - s.ret, 8) + 0.0 AS vs_sector, round(w.v, 8) + 0.0 AS sector_vs_benchmark, round(CASE WHEN p.n > 60 THEN p.beta END, 8) + 0.0 AS beta, round(CASE WHEN p.n > 60 THEN p.correlation END, 8) + 0.0 AS correlation FROM own o JOIN bench b ON b.ticker = o.ticker JOIN sect s ON s.ticker = o.ticker JOIN whole_sect w ON true JOIN paired p ON p.ticker = o.ticker",
        own="SELECT ticker, max(date) AS last, max(close) FILTER (k = 1) / max(close) FILTER (k = 64) - 1 AS own FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars) GROUP BY 1",
        sector=SECTOR,
        bench="SELECT ticker, max(close) FILTER (k = 1) / max(close) FILTER (k = 64) - 1 AS ret FROM (SELECT o.ticker, i.close, row_number() OVER (PARTITION BY o.ticker ORDER BY i.date DESC) AS k FROM own o JOIN index_closes i ON i.date <= o.last) GROUP BY 1",
        sect="SELECT ticker, max(close) FILTER (k = 1) / max(close) FILTER (k = 64) - 1 AS ret FROM (SELECT o.ticker, i.close, row_number() OVER (PARTITION BY o.ticker ORDER BY i.date DESC) AS k FROM own o JOIN sector i ON i.date <= o.last) GROUP BY 1",
        whole_sect="SELECT (SELECT max(close) FILTER (k = 1) / max(close) FILTER (k = 64) FROM (SELECT close, row_number() OVER (ORDER BY date DESC) AS k FROM sector)) - (SELECT max(close) FILTER (k = 1) / max(close) FILTER (k = 64) FROM (SELECT close, row_number() OVER (ORDER BY date DESC) AS k FROM index_closes)) AS v",
        iret="SELECT date, ln(close) - lag(ln(close)) OVER (ORDER BY date) AS y FROM index_closes",
        paired="SELECT ticker, count(*) AS n, covar_samp(x, y) / var_samp(y) AS beta, corr(x, y) AS correlation FROM (SELECT r.ticker, r.r AS x, i.y, row_number() OVER (PARTITION BY r.ticker ORDER BY r.date DESC) AS k FROM rets r JOIN iret i ON i.date = r.date WHERE r.r IS NOT NULL AND i.y IS NOT NULL) WHERE k <= 252 GROUP BY 1",
    ),
)(lambda s, d: fundamentals.market_context(bars(s, d), index_closes(s, d), bars(s, d).where("ticker = 'NO'").select("date", "close")))


# ---- statistics ----------------------------------------------------------------------------


def returns(s: SparkSession, d: str) -> DataFrame:
    return forecasts.log_returns(bars(s, d))


# The error function by its series of positive terms; x must not be null.
ERF = "(CASE WHEN {z} = 0 THEN 0.0 ELSE list_sum(list_transform(range(0, 150), lambda n: exp((2 * n + 1) * ln(abs({z})) - lgamma(n + 1.5) - {z} * {z}))) * sign({z}) END)"
query("stat_normal_cdf", sql(f"SELECT ticker, date, {r8('0.5 + 0.5 * ' + ERF.format(z='z') + ' AS p')} FROM (SELECT *, r / 0.01 / sqrt(2) AS z FROM rets WHERE r IS NOT NULL)"))(lambda s, d: returns(s, d).where("r IS NOT NULL").select("ticker", "date", S.normal_cdf(C("r") / 0.01).alias("p")))
query("stat_normal_logpdf", sql(f"SELECT ticker, date, {r8('-0.5 * ((r - 0.001) / 0.01) * ((r - 0.001) / 0.01) - ln(0.01) - 0.5 * ln(2 * pi()) AS y')} FROM rets"))(lambda s, d: returns(s, d).select("ticker", "date", S.normal_logpdf(C("r"), 0.001, 0.01).alias("y")))
query("stat_unit_t_logpdf", sql(f"SELECT ticker, date, {r8(f'{S.t_constant(5.0)!r} - 3.0 * ln(1 + (r / 0.01) * (r / 0.01) / 3.0) AS y')} FROM rets"))(lambda s, d: returns(s, d).select("ticker", "date", S.unit_t_logpdf(C("r") / 0.01, 5.0).alias("y")))
query("stat_chi_square_tail", sql(f"SELECT ticker, date, {r8('CASE WHEN v <= 0 THEN 1.0 ELSE exp(-v / 2) END AS p')} FROM (SELECT *, (r / 0.01) * (r / 0.01) AS v FROM rets) WHERE v IS NOT NULL"))(lambda s, d: returns(s, d).where("r IS NOT NULL").select("ticker", "date", S.chi_square_tail((C("r") / 0.01) * (C("r") / 0.01), 2).alias("p")))
FIVE = "1 - " + ERF.format(z="sqrt(h)") + " + exp(-h) * (sqrt(h) / gamma(1.5) + h * sqrt(h) / gamma(2.5))"
query("stat_chi_square_tail_five", sql(f"SELECT ticker, date, {r8(FIVE + ' AS p')} FROM (SELECT *, (r / 0.006) * (r / 0.006) / 2 AS h FROM rets WHERE r IS NOT NULL)"))(lambda s, d: returns(s, d).where("r IS NOT NULL").select("ticker", "date", S.chi_square_tail((C("r") / 0.006) * (C("r") / 0.006), 5).alias("p")))
MOMENTS = "SELECT ticker, count(r) AS n, avg(r) AS m, stddev_pop(r) AS sd FROM rets GROUP BY 1"
CTES["shape"] = f"SELECT r.ticker, any_value(m.n) AS n, avg(((r.r - m.m) / m.sd) ** 3) AS skewness, avg(((r.r - m.m) / m.sd) ** 4) - 3 AS excess_kurtosis FROM rets r JOIN ({MOMENTS}) m ON m.ticker = r.ticker WHERE r.r IS NOT NULL GROUP BY 1"
JB = "n / 6 * (skewness * skewness + excess_kurtosis * excess_kurtosis / 4)"
query("stat_jarque_bera", sql(f"SELECT ticker, n, {r8('skewness', 'excess_kurtosis', JB + ' AS jb', f'exp(-({JB}) / 2) AS p_value')} FROM shape"))(lambda s, d: S.jarque_bera(returns(s, d), "r", ["ticker"]))
query("stat_arch_lm", sql(f"SELECT ticker, count(*) AS n, {r8('count(*) * regr_r2(y, y1) AS lm')} FROM (SELECT ticker, r * r AS y, lag(r * r) OVER {W} AS y1 FROM rets WHERE r IS NOT NULL) WHERE y1 IS NOT NULL GROUP BY 1"))(lambda s, d: S.arch_lm_one(returns(s, d), "r", ["ticker"], "date"))
_lagged = "SELECT ticker, y, x1, x2, x3, x4, x5 FROM (SELECT ticker, r * r AS y, " + ", ".join(f"lag(r * r, {k}) OVER {W} AS x{k}" for k in range(1, 6)) + " FROM rets WHERE r IS NOT NULL) WHERE x5 IS NOT NULL"
for _k in range(1, 5):  # each lag less what the lags before it explain, so that shares of variance add up
    _own = "OVER (PARTITION BY ticker)"
    _lagged = "SELECT ticker, y, " + ", ".join([f"x{j}" for j in range(1, _k + 1)] + [f"x{j} - avg(x{j}) {_own} - covar_pop(x{j}, x{_k}) {_own} / var_pop(x{_k}) {_own} * (x{_k} - avg(x{_k}) {_own}) AS x{j}" for j in range(_k + 1, 6)]) + f" FROM ({_lagged})"
_lm = "SELECT ticker, count(*) AS n, count(*) * (" + " + ".join(f"pow(corr(y, x{k}), 2)" for k in range(1, 6)) + f") AS lm FROM ({_lagged}) GROUP BY 1"
query("stat_arch_lm_five", sql(f"SELECT ticker, n, round(lm, 6) + 0.0 AS lm, round({FIVE}, 6) + 0.0 AS p_value FROM (SELECT *, lm / 2 AS h FROM ({_lm}))"))(lambda s, d: S.arch_lm(returns(s, d), "r", ["ticker"], "date", 5).withColumns({"lm": F.round("lm", 6), "p_value": F.round("p_value", 6)}))
_P = 32  # columns: 1, the level, up to 29 lags, the change


def _swept_sql(m: str, k: str, p: int = _P) -> str:
    pivot = f"{m}[{k} * {p + 1} + 1]"
    return f"CASE WHEN abs({pivot}) > 1e-12 THEN list_transform(range(0, {p * p}), lambda z: CASE WHEN z // {p} = {k} AND z % {p} = {k} THEN -1 / {pivot} WHEN z // {p} = {k} OR z % {p} = {k} THEN {m}[z + 1] / {pivot} ELSE {m}[z + 1] - {m}[(z // {p}) * {p} + {k} + 1] * {m}[{k} * {p} + z % {p} + 1] / {pivot} END) ELSE {m} END"


def _gram_sql(rows: str, p: int = _P) -> str:
    sums = f"SELECT ticker, cap, i, count(*) AS n, sum(v[i // {p} + 1] * v[i % {p} + 1]) AS s FROM {rows}, (SELECT unnest(range(0, {p * p})) AS i) GROUP BY 1, 2, 3"
    return f"SELECT ticker, cap, any_value(n) AS n, list(s ORDER BY i) AS m FROM ({sums}) GROUP BY 1, 2"


_ROW = f"[1.0, y] || list_transform(range(1, {_P - 2}), lambda k: CASE WHEN k <= {{cap}} THEN lags[k] ELSE 0.0 END) || [d] AS v"
ADF = {
    "adf_base": f"SELECT ticker, count(*) OVER (PARTITION BY ticker) AS n, row_number() OVER {W} - 2 AS t, x - lag(x) OVER {W} AS d, lag(x) OVER {W} - avg(x) OVER (PARTITION BY ticker) AS y FROM rets",
    "adf_lag": f"SELECT ticker, t, CAST(floor(12 * pow(n / 100.0, 0.25)) AS BIGINT) AS most, d, y, list_reverse(list(d) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN {_P - 3} PRECEDING AND 1 PRECEDING)) AS lags FROM (SELECT * FROM adf_base WHERE t >= 0)",
    "adf_one": f"SELECT ticker, most AS cap, {_ROW.format(cap='most')} FROM adf_lag WHERE t >= most",
    "adf_gram": _gram_sql("adf_one"),
    "adf_sweep": f"SELECT ticker, cap, n, CAST(0 AS BIGINT) AS k, m, [m[{_P * _P}]] AS rss FROM adf_gram UNION ALL SELECT ticker, cap, n, k + 1, w, rss || [w[{_P * _P}]] FROM (SELECT *, {_swept_sql('m', 'k')} AS w FROM adf_sweep WHERE k < {_P - 1})",
    "adf_lags": f"SELECT ticker, arg_min(j, n * ln(rss[j + 3] / n) + 2 * (j + 2)) AS cap FROM (SELECT ticker, n, rss, unnest(range(0, cap + 1)) AS j FROM adf_sweep WHERE k = {_P - 1}) GROUP BY 1",
    "adf_two": f"SELECT l.ticker, c.cap, {_ROW.format(cap='c.cap')} FROM adf_lag l JOIN adf_lags c ON c.ticker = l.ticker WHERE t >= c.cap",
    "adf_gram_two": _gram_sql("adf_two"),
    "adf_last": f"SELECT ticker, cap, n, CAST(0 AS BIGINT) AS k, m FROM adf_gram_two UNION ALL SELECT ticker, cap, n, k + 1, {_swept_sql('m', 'k')} FROM adf_last WHERE k < cap + 2",
    "adf": f"SELECT ticker, cap, n, m[{(_P - 1) * _P + 2}] / sqrt(m[{_P * _P}] / (n - cap - 2) * -m[{_P + 2}]) AS statistic, " + " + ".join(f"({b!r}) / pow(n, {i})" for i, b in enumerate(S.UNIT_ROOT[0.05])) + " AS critical FROM adf_last WHERE k = cap + 2",
}
query("stat_unit_root", sql("SELECT ticker, round(statistic, 5) + 0.0 AS statistic, CAST(cap AS INTEGER) AS lags, CAST(n AS INTEGER) AS observations, round(critical, 8) + 0.0 AS critical, statistic < critical AS stationary FROM adf", **ADF))(lambda s, d: S.unit_root(returns(s, d), "x", ["ticker"], "date").withColumn("statistic", F.round("statistic", 5)))
query("stat_dickey_fuller_zero", sql(f"SELECT ticker, n, round(b / sqrt((syy - b * b * sxx) / (n - 2) / sxx), 5) + 0.0 AS statistic FROM (SELECT ticker, count(*) AS n, regr_slope(d, l) AS b, regr_sxx(d, l) AS sxx, regr_syy(d, l) AS syy FROM (SELECT ticker, lag(x) OVER {W} AS l, x - lag(x) OVER {W} AS d FROM rets) WHERE d IS NOT NULL GROUP BY 1)"))(lambda s, d: S.dickey_fuller_zero(returns(s, d), "x", ["ticker"], "date").withColumn("statistic", F.round("statistic", 5)))


# ---- models and synthesis ------------------------------------------------------------------


def gbm_fits(s: SparkSession, d: str) -> DataFrame:
    return forecasts.origins(forecasts.gbm(returns(s, d)), FIRST, STEP, HORIZON)


def sample_arrays(s: SparkSession, d: str, paths: int = PATHS) -> DataFrame:
    """Deterministic forecasts of four stand-in models at each origin, an array of paths in a row: GBM with
    scaled volatility. An origin's own hash starts its points, so that rows can be dealt to any task."""
    # Models and hashes come out of a generator: Spark moves no later filter, with the paths in it, below it.
    start = lambda m, k: (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("42"), "ticker", C("position").cast("string"), F.lit(m), F.lit(k))), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), (C("volatility") * k).alias("sd"), start(m, "u").alias("u"), start(m, "v").alias("v")) for m, k in SCALES.items()]))
    rows = gbm_fits(s, d).select("ticker", "date", "position", "realized", "drift", each.alias("m"))
    rows = rows.repartition(4 * s.sparkContext.defaultParallelism, "ticker", "position").select("ticker", "date", "position", "realized", "drift", "m.*")
    turned = lambda c, i, turn: C(c) + i * turn - F.floor(C(c) + i * turn)
    value = lambda i: HORIZON * C("drift") + math.sqrt(HORIZON) * C("sd") * F.sqrt(-2 * F.ln(1e-9 + (1 - 2e-9) * turned("u", i, TURNS[0]))) * F.cos(2 * math.pi * turned("v", i, TURNS[1]))
    return rows.select(*evaluate.ORIGIN, "realized", F.transform(F.sequence(F.lit(1), F.lit(paths)), value).alias("samples"))


def records(s: SparkSession, d: str) -> DataFrame:
    return evaluate.score_arrays(sample_arrays(s, d), LEVELS)


FULL = SETTINGS["forecast"]["monte_carlo_paths"]


def full_samples(s: SparkSession, d: str) -> DataFrame:
    """The same with all paths of the settings, a row for each path."""
    return sample_arrays(s, d, FULL).select(*evaluate.ORIGIN, "realized", F.explode("samples").alias("value"))


def full_records(s: SparkSession, d: str) -> DataFrame:
    """Records of all paths of the settings, scored once and kept."""
    return durable(evaluate.score_arrays(sample_arrays(s, d, FULL), LEVELS))


def full_sql(text: str) -> str:
    return text.replace(f"range(1, {PATHS + 1})", f"range(1, {FULL + 1})").replace(" records AS (", " records AS MATERIALIZED (")


def regime_records(s: SparkSession, d: str) -> DataFrame:
    return records(s, d).withColumns({"earnings_in_window": C("position") % 3 == 0, "turbulent_probability": F.when(C("position") % 50 < 25, 0.7).otherwise(0.2), "trending": F.when(C("position") % 4 != 0, (C("position") % 2).cast("double"))})


ORIGIN8 = "ticker, date, position"
query("model_gbm_fit", sql(f"SELECT {ORIGIN8}, {r8('drift', 'volatility')} FROM fits"))(lambda s, d: forecasts.gbm(returns(s, d)).select("ticker", "date", "position", "drift", "volatility"))
DAY = "(drift + volatility * sqrt(-2 * ln((CAST('0x' || substr(md5('42|' || ticker || '|' || position || '|' || path || '|{k}|u'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)) * cos(2 * pi() * (CAST('0x' || substr(md5('42|' || ticker || '|' || position || '|' || path || '|{k}|v'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0))"
query("model_gbm_paths", sql(f"SELECT ticker, date, position, path, {r8('realized', ' + '.join(f'greatest(ln(0.97), least(ln(1.03), {DAY.format(k=k)}))' for k in range(1, 6)) + ' AS value')} FROM origins, (SELECT unnest(range(1, 21)) AS path)"))(lambda s, d: forecasts.gbm_paths(gbm_fits(s, d), HORIZON, 20, 42, 0.03).select("ticker", "date", "position", "path", "realized", "value"))
SLOW_GARCH = (0.0005, 0.0003, 0.0004, 0.999)


def garch_parts(o: float, a: float, g: float, b: float) -> dict[str, str]:
    return {
        "shocks": f"SELECT ticker, date, position, row_number() OVER {W} AS k, 100 * (r - avg(r) OVER (PARTITION BY ticker)) AS e FROM rets WHERE r IS NOT NULL",
        "path": f"SELECT ticker, CAST(NULL AS DATE) AS date, CAST(0 AS BIGINT) AS position, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS e, CAST({o / (1 - a - g / 2 - b)!r} AS DOUBLE) AS v FROM (SELECT DISTINCT ticker FROM shocks) UNION ALL SELECT s.ticker, s.date, s.position, s.k, s.e, {o} + ({a} + CASE WHEN s.e < 0 THEN {g} ELSE 0.0 END) * s.e * s.e + {b} * p.v FROM path p JOIN shocks s ON s.ticker = p.ticker AND s.k = p.k + 1",
    }


def garch_sql(*parameters: float) -> str:
    return sql(f"SELECT ticker, date, position, {r8('e AS shock', 'v AS variance')} FROM path WHERE k > 0", **garch_parts(*parameters))


for _name, _p in (("model_garch_path", GARCH), ("model_garch_path_slow", SLOW_GARCH)):
    query(_name, garch_sql(*_p))(lambda s, d, p=_p: forecasts.garch_path(returns(s, d), *p))
MERTON = (0.03, 0.8, 0.05, -0.2, 2.0)


def _merton_sql(most: int = 8) -> str:
    mu, sigma, lam, jm, js = MERTON
    terms = [f"exp({-lam + n * math.log(lam) - math.lgamma(n + 1) - 0.5 * math.log(2 * math.pi * (sigma**2 + n * js**2))!r} - 0.5 * (v - ({mu + n * jm!r})) * (v - ({mu + n * jm!r})) / {sigma**2 + n * js**2!r})" for n in range(most + 1)]
    return "ln(" + " + ".join(terms) + ")"


query("model_merton_logpdf", sql(f"SELECT ticker, date, {r8(_merton_sql() + ' AS y')} FROM (SELECT *, 100 * r AS v FROM rets)"))(lambda s, d: returns(s, d).select("ticker", "date", forecasts.merton_logpdf(100 * C("r"), *MERTON, 8).alias("y")))
query("model_reaction_days", sql("SELECT ticker, date FROM reacting"))(lambda s, d: forecasts.reaction_days(earnings(s, d), bars(s, d).select("ticker", "date"), "Asia/Kolkata", "15:30"))


def reactions(s: SparkSession, d: str) -> DataFrame:
    return forecasts.reaction_days(earnings(s, d), bars(s, d).select("ticker", "date"), "Asia/Kolkata", "15:30")


CTES["multiplier"] = "SELECT r.ticker, count(d.date) AS events, CASE WHEN count(d.date) >= 8 THEN greatest(avg((r.r - m.m) ** 2) FILTER (d.date IS NOT NULL) / avg((r.r - m.m) ** 2) FILTER (d.date IS NULL), 1.0) END AS multiplier FROM rets r JOIN (SELECT ticker, avg(r) AS m FROM rets GROUP BY 1) m ON m.ticker = r.ticker LEFT JOIN reacting d ON d.ticker = r.ticker AND d.date = r.date WHERE r.r IS NOT NULL GROUP BY 1"
query("model_earnings_multiplier", sql(f"SELECT ticker, events, {r8('multiplier')} FROM multiplier"))(lambda s, d: forecasts.earnings_multiplier(returns(s, d), reactions(s, d), 8))
query("model_horizon_multipliers", sql("SELECT b.ticker, b.date, round(CASE WHEN d.date IS NOT NULL AND m.multiplier IS NOT NULL THEN sqrt(m.multiplier) ELSE 1.0 END, 8) + 0.0 AS scale FROM bars b LEFT JOIN reacting d ON d.ticker = b.ticker AND d.date = b.date LEFT JOIN multiplier m ON m.ticker = b.ticker"))(lambda s, d: forecasts.horizon_multipliers(bars(s, d).select("ticker", "date"), reactions(s, d), forecasts.earnings_multiplier(returns(s, d), reactions(s, d), 8)))
OU = "SELECT ticker, b, a, sqrt((syy - b * b * sxx) / (n - 2)) AS sd, a / nullif(1 - b, 0) AS level, last FROM (SELECT ticker, regr_slope(now, before) AS b, regr_intercept(now, before) AS a, regr_sxx(now, before) AS sxx, regr_syy(now, before) AS syy, count(before) AS n, max_by(now, position) AS last FROM (SELECT ticker, position, x AS now, lag(x) OVER (PARTITION BY ticker ORDER BY date) AS before FROM rv) GROUP BY 1)"
REV = {
    "rn": "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM zed",
    "rx": "SELECT *, pow(0.97, (k - 1) % 2000) * sum(0.01 * z * pow(0.97, -((k - 1) % 2000))) OVER (PARTITION BY ticker, (k - 1) // 2000 ORDER BY date) AS lx FROM rn",
    "rv": "SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS position, ln(round(100 * exp(lx), 4)) AS x FROM rx",
}
OK = "b > 0 AND b < 1"
query("model_ornstein_uhlenbeck", sql("SELECT ticker, " + ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in {"persistence": "b", "intercept": f"CASE WHEN {OK} THEN a END", "residual_volatility": f"CASE WHEN {OK} THEN sd END", "half_life": f"CASE WHEN {OK} THEN ln(2) / -ln(b) END", "long_run_price": f"CASE WHEN {OK} THEN exp(level) END", "daily_drift": f"CASE WHEN {OK} THEN (level - last) * (1 - pow(b, 5)) / 5 END"}.items()) + f" FROM ({OU})", **REV))(lambda s, d: forecasts.ornstein_uhlenbeck(forecasts.log_returns(fixtures.rev_bars(s, d)), 5).select("ticker", *[F.round(c, 6).alias(c) for c in ("persistence", "intercept", "residual_volatility", "half_life", "long_run_price", "daily_drift")]))
STATES = ([0.6, 0.4], [[0.97, 0.03], [0.06, 0.94]], [0.0006, -0.0004], [0.00006, 0.0003])
_p, _t, _m, _v = STATES
_density = lambda i: f"exp(-0.5 * (o.r - ({_m[i]})) * (o.r - ({_m[i]})) / {_v[i]}) / sqrt({_v[i]})"
_ahead = [f"(f.p0 * {_t[0][i]} + f.p1 * {_t[1][i]}) * {_density(i)}" for i in (0, 1)]
_first = [f"{_p[i]} * {_density(i)}" for i in (0, 1)]
REGIME_PARTS = {
    "obs": "SELECT ticker, date, position, r FROM rets WHERE r IS NOT NULL",
    "filt": f"SELECT o.ticker, CAST(o.date AS VARCHAR) AS date, o.position, {_first[0]} / ({_first[0]} + {_first[1]}) AS p0, {_first[1]} / ({_first[0]} + {_first[1]}) AS p1 FROM obs o WHERE o.position = 1 UNION ALL SELECT o.ticker, CAST(o.date AS VARCHAR), o.position, {_ahead[0]} / ({_ahead[0]} + {_ahead[1]}), {_ahead[1]} / ({_ahead[0]} + {_ahead[1]}) FROM filt f JOIN obs o ON o.ticker = f.ticker AND o.position = f.position + 1",
}
query(
    "model_hmm_filter",
    sql(
        f"SELECT ticker, date, position, {r8('p1 AS turbulent')} FROM filt UNION ALL SELECT ticker, CAST(date AS VARCHAR) AS date, position, NULL FROM rets WHERE position = 0",
        **REGIME_PARTS,
    ),
)(lambda s, d: filters.regime_probability(returns(s, d), *STATES))
TREND = (0.0001, 0.4, 0.002)
_l, _q, _s = TREND
# level, tilt, and the covariance (a, c, b) after each day; predicted: level + tilt, a + 2c + b + 1, c + b, b + slope ratio.
_pa, _pc, _pb = "(k.a + 2 * k.c + k.b + 1)", "(k.c + k.b)", f"(k.b + {_s})"
TREND_PARTS = {"kal": f"SELECT ticker, CAST(date AS VARCHAR) AS date, position, x AS level, CAST(0 AS DOUBLE) AS tilt, 1e4 - 1e8 / (1e4 + {_q}) AS a, CAST(0 AS DOUBLE) AS c, CAST(1e4 AS DOUBLE) AS b FROM rets WHERE position = 0 UNION ALL SELECT o.ticker, CAST(o.date AS VARCHAR), o.position, k.level + k.tilt + {_pa} / ({_pa} + {_q}) * (o.x - k.level - k.tilt), k.tilt + {_pc} / ({_pa} + {_q}) * (o.x - k.level - k.tilt), {_pa} - {_pa} * {_pa} / ({_pa} + {_q}), {_pc} - {_pa} * {_pc} / ({_pa} + {_q}), {_pb} - {_pc} * {_pc} / ({_pa} + {_q}) FROM kal k JOIN rets o ON o.ticker = k.ticker AND o.position = k.position + 1"}
query(
    "model_kalman_trend",
    sql(
        f"SELECT ticker, date, position, round(CASE WHEN position >= 2 THEN tilt / sqrt(b * {_l}) END, 5) + 0.0 AS slope_z FROM kal",
        **TREND_PARTS,
    ),
)(lambda s, d: filters.trend_strength(returns(s, d), *TREND).withColumn("slope_z", F.round("slope_z", 5)))
PRIOR = (0.002, 0.004)
query(
    "syn_drift_posterior",
    sql(
        f"SELECT ticker, outcomes, {r8(f'CASE WHEN outcomes >= 20 THEN ({PRIOR[0]} / pow({PRIOR[1]}, 2) + s / v) / (1 / pow({PRIOR[1]}, 2) + outcomes / v) ELSE {PRIOR[0]} END AS mean', f'CASE WHEN outcomes >= 20 THEN 1 / sqrt(1 / pow({PRIOR[1]}, 2) + outcomes / v) ELSE {PRIOR[1]} END AS sd')} FROM told",
        told=f"SELECT ticker, count(realized) AS outcomes, sum(realized) AS s, var_samp(realized) AS v FROM fits WHERE position % {HORIZON} = (n - 1) % {HORIZON} AND position <= n - 1 - {HORIZON} GROUP BY 1",
    ),
)(lambda s, d: filters.prior_and_outcomes(returns(s, d), horizon=HORIZON, prior_mean=PRIOR[0], prior_sd=PRIOR[1]))
query("syn_forward_returns", sql(f"SELECT ticker, date, {r8('realized AS forward')} FROM fits"))(lambda s, d: returns(s, d).select("ticker", "date", forecasts.forward_return(HORIZON).alias("forward")))
query("syn_drift_prior", sql(f"SELECT ticker, {r8('(0.10 + bias * 0.03 * confidence) * 5 / 248 AS mean', '0.2 * 5 / 248 + 0.0 * bias AS sd')} FROM assessed"))(lambda s, d: fundamentals.fair_value(scores(s, d), FUND).select("ticker", forecasts.drift_prior(0.10 + C("annual_drift_tilt"), 0.2, 5, 248)[0].alias("mean"), F.lit(forecasts.drift_prior(0.1, 0.2, 5, 248)[1]).alias("sd")))
query("syn_next_trading_days", sql("SELECT ticker, step, date FROM (SELECT ticker, CAST(date AS DATE) AS date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS step FROM (SELECT ticker, unnest(generate_series(max(date) + INTERVAL 1 DAY, max(date) + INTERVAL 14 DAY, INTERVAL 1 DAY)) AS date FROM bars GROUP BY 1) WHERE isodow(date) <= 5) WHERE step <= 5"))(lambda s, d: forecasts.next_trading_days(bars(s, d).groupBy("ticker").agg(F.max("date").alias("date")), 5))
LAST = f"(SELECT ticker, max(position) AS position FROM origins GROUP BY 1)"
PRICE = "".join(f", round(c * exp(quantile_cont(value, {(1 - v) / 2})), 6) + 0.0 AS low_{round(100 * v)}, round(c * exp(quantile_cont(value, {1 - (1 - v) / 2})), 6) + 0.0 AS high_{round(100 * v)}" for v in LEVELS)
MOVES = "".join(f", round(avg(CASE WHEN value > ln(1 + {t}) THEN 1.0 ELSE 0.0 END), 8) AS p_rise_{round(100 * t)}, round(avg(CASE WHEN value <= ln(1 - {t}) THEN 1.0 ELSE 0.0 END), 8) AS p_fall_{round(100 * t)}" for t in (0.02, 0.05))
query("syn_price_summary", sql(f"SELECT s.ticker, any_value(c) AS close, round(any_value(c) * exp(quantile_cont(value, 0.5)), 6) + 0.0 AS median_price{PRICE.replace('round(c *', 'round(any_value(c) *')}, round(avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END), 8) AS p_up{MOVES} FROM samples s JOIN {LAST} l ON l.ticker = s.ticker AND l.position = s.position JOIN lastbar b ON b.ticker = s.ticker WHERE model = 'engine' GROUP BY 1"))(lambda s, d: _price_summary(s, d))


def _price_summary(s: SparkSession, d: str) -> DataFrame:
    paths = sample_arrays(s, d).where("model = 'engine'")
    last = paths.groupBy("ticker").agg(F.max_by("samples", "position").alias("samples")).select("ticker", F.explode("samples").alias("value"))
    closes = bars(s, d).groupBy("ticker").agg(F.max_by("close", "date").alias("close"))
    out = forecasts.price_summary(last, closes, LEVELS, [0.02, 0.05])
    return out.select("ticker", "close", *[F.round(c, 6).alias(c) for c in out.columns if c.startswith(("low", "high", "median"))], *[c for c in out.columns if c.startswith("p_")])


# ---- backtest and evaluation ---------------------------------------------------------------

query("bt_origins", sql(f"SELECT ticker, date, position, CAST(floor((position - {FIRST}) / 25) AS BIGINT) AS refit, {r8('realized')} FROM origins"))(lambda s, d: gbm_fits(s, d).select("ticker", "date", "position", forecasts.refit_of(C("position"), FIRST, 5, 21).alias("refit"), "realized"))
HITS = ", ".join(evaluate.level_name(v) for v in LEVELS)
query("eval_score_forecasts", sql(f"SELECT ticker, date, position, model, {r8('realized', 'crps', 'pit', 'p_up', 'brier')}, {HITS} FROM records"))(records)
query("eval_central_interval", sql(f"SELECT ticker, date, position, model, {r8('quantile_cont(value, 0.05) AS low', 'quantile_cont(value, 0.95) AS high')} FROM samples GROUP BY 1, 2, 3, 4"))(lambda s, d: evaluate.central_interval_arrays(sample_arrays(s, d), 0.9))
query("eval_reliability", sql("SELECT ticker, model, CAST(bin AS INTEGER) AS bin, round(avg(p_up), 8) AS forecast, round(avg(CASE WHEN realized > 0 THEN 1.0 ELSE 0.0 END), 8) AS frequency, count(*) AS size, round(2 * sqrt(greatest(avg(p_up) * (1 - avg(p_up)), 1e-6) / count(*)), 8) AS tolerance FROM (SELECT *, CASE WHEN k = 1 THEN 0 ELSE ((k - 1) * least(10, greatest(2, n // 75)) + n - 2) // (n - 1) - 1 END AS bin FROM (SELECT *, row_number() OVER (PARTITION BY ticker, model ORDER BY p_up, date) AS k, count(*) OVER (PARTITION BY ticker, model) AS n FROM records)) GROUP BY 1, 2, 3"))(lambda s, d: evaluate.reliability(records(s, d)))
query("eval_interval_calibration", sql("SELECT ticker, model, CAST(level AS DOUBLE) AS level, round(avg(CASE WHEN abs(pit - 0.5) <= level / 2 THEN 1.0 ELSE 0.0 END), 8) AS observed, count(*) AS n, round(2 * sqrt(level * (1 - level) / count(*)), 8) AS tolerance FROM records, (SELECT CAST(unnest([" + ", ".join(map(str, evaluate.LEVELS)) + "]) AS DOUBLE) AS level) GROUP BY ticker, model, level"))(lambda s, d: evaluate.interval_calibration(records(s, d)))
query("eval_pit_histogram", sql("SELECT e.ticker, e.model, CAST(e.bin AS INTEGER) AS bin, round(coalesce(c.c, 0) / e.n, 8) AS share FROM (SELECT ticker, model, count(*) AS n, unnest(range(0, 10)) AS bin FROM records GROUP BY 1, 2) e LEFT JOIN (SELECT ticker, model, least(floor(pit * 10), 9) AS bin, count(*) AS c FROM records GROUP BY 1, 2, 3) c ON c.ticker = e.ticker AND c.model = e.model AND c.bin = e.bin"))(lambda s, d: evaluate.pit_histogram(records(s, d)))
SKILL = "round(1 - avg(crps) / avg(b_crps), 8) + 0.0 AS crps_skill"
query("eval_segments", sql(f"SELECT ticker, segment, count(*) AS forecasts, {SKILL}, round(avg(CAST(hit_90 AS DOUBLE)), 8) AS coverage_90, round(1 - avg(brier) / avg(b_brier), 8) + 0.0 AS brier_skill FROM (SELECT *, unnest([CASE WHEN turbulent_probability > 0.5 THEN 'turbulent regime (HMM)' ELSE 'calm regime (HMM)' END, CASE WHEN trending = 1 THEN 'trending (ADX)' WHEN trending = 0 THEN 'ranging (ADX)' END, CASE WHEN earnings_in_window THEN 'earnings in window' ELSE 'no earnings in window' END, CAST(year(date) AS VARCHAR)]) AS segment FROM regimes WHERE model = 'engine') WHERE segment IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5"))(lambda s, d: evaluate.segments(regime_records(s, d)))
query("eval_worst_misses", sql(f"SELECT ticker, rank, date, {r8('exp(realized) - 1 AS realized_return', 'pit')} FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY abs(pit - 0.5) DESC, date) AS rank FROM records WHERE model = 'engine') WHERE rank <= 5"))(lambda s, d: evaluate.worst_misses(records(s, d)))
query("eval_tail_miss_rate", sql("SELECT ticker, round(1 - avg(CAST(hit_95 AS DOUBLE)), 8) AS tail_miss_rate FROM records WHERE model = 'engine' GROUP BY 1"))(lambda s, d: evaluate.tail_miss_rate(records(s, d)))
COVER = ", ".join(f"round(avg(CAST(hit_{round(100 * v)} AS DOUBLE)), 8) AS coverage_{round(100 * v)}" for v in LEVELS)
query("eval_compare_models", sql(f"SELECT ticker, model, count(*) AS forecasts, round(avg(crps), 8) AS mean_crps, {SKILL}, round(avg(brier), 8) AS brier, round(1 - avg(brier) / avg(b_brier), 8) + 0.0 AS brier_skill, {COVER} FROM beside GROUP BY 1, 2"))(lambda s, d: evaluate.skills(records(s, d), LEVELS))
KS = "SELECT ticker, model, max(n) AS n, max(greatest(i / n - pit, pit - (i - 1) / n)) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY ticker, model ORDER BY pit) AS i, count(*) OVER (PARTITION BY ticker, model) AS n FROM records) GROUP BY 1, 2"
query("stat_ks_uniform", sql(f"SELECT ticker, model, n, {r8('distance', 'least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * k * k * s * s))))) AS p_value')} FROM (SELECT *, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * distance AS s FROM ({KS}))"))(lambda s, d: S.ks_uniform(records(s, d), "pit", ["ticker", "model"]))
KS_P = f"SELECT ticker, model, least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * k * k * s * s))))) AS pit_ks_p FROM (SELECT *, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * distance AS s FROM ({KS}))"
DM = "SELECT ticker, model, date, d, d - avg(d) OVER (PARTITION BY ticker, model) AS c FROM (SELECT *, crps - b_crps AS d FROM beside WHERE model <> 'gbm')"
query("stat_diebold_mariano", sql(f"SELECT ticker, model, n, {r8('m AS mean_difference', 'CASE WHEN lrv > 0 THEN m / sqrt(lrv / n) * sqrt((n - 3 + 2 / n) / n) ELSE 0.0 END AS statistic')} FROM (SELECT ticker, model, count(*) AS n, avg(d) AS m, avg(c * c) + coalesce(sum(c * c1), 0) / count(*) AS lrv FROM (SELECT *, lag(c) OVER (PARTITION BY ticker, model ORDER BY date) AS c1 FROM ({DM})) GROUP BY 1, 2)"))(lambda s, d: S.diebold_mariano(evaluate.beside(records(s, d)).where("model != 'gbm'"), "crps", "b_crps", ["ticker", "model"], "date", with_p=False))


def dm_p_sql(loss: str) -> str:
    """The two-sided p value of the loss differences: the normal tail by the error function's series."""
    inner = f"SELECT *, lag(c) OVER (PARTITION BY ticker, model ORDER BY date) AS c1 FROM ({DM.replace('crps', loss)})"
    moments = f"SELECT ticker, model, count(*) AS n, avg(d) AS m, avg(c * c) + coalesce(sum(c * c1), 0) / count(*) AS lrv FROM ({inner}) GROUP BY 1, 2"
    z = f"SELECT ticker, model, CASE WHEN lrv > 0 THEN abs(m) / sqrt(lrv / n) * sqrt((n - 3 + 2 / n) / n) ELSE 0.0 END / sqrt(2) AS z FROM ({moments})"
    return f"SELECT ticker, model, 2 * (1 - (0.5 + 0.5 * {ERF.format(z='z')})) AS p FROM ({z})"


CTES["compared"] = (
    f"SELECT s.*, k.pit_ks_p, c.p AS crps_dm_p, b.p AS brier_dm_p FROM (SELECT ticker, model, count(*) AS forecasts, avg(crps) AS mean_crps, 1 - avg(crps) / avg(b_crps) AS crps_skill, avg(brier) AS brier, 1 - avg(brier) / avg(b_brier) AS brier_skill, "
    + ", ".join(f"avg(CAST(hit_{round(100 * v)} AS DOUBLE)) AS coverage_{round(100 * v)}" for v in LEVELS)
    + f" FROM beside GROUP BY 1, 2) s JOIN ({KS_P}) k USING (ticker, model) LEFT JOIN ({dm_p_sql('crps')}) c USING (ticker, model) LEFT JOIN ({dm_p_sql('brier')}) b USING (ticker, model)"
)
_figures = ["mean_crps", "crps_skill", "brier", "brier_skill", *[f"coverage_{round(100 * v)}" for v in LEVELS], "pit_ks_p", "crps_dm_p", "brier_dm_p"]
query("eval_compare_models_tests", full_sql(sql(f"SELECT ticker, model, forecasts, {r8(*_figures)} FROM compared")))(lambda s, d: evaluate.compare_models(full_records(s, d), LEVELS))
query("eval_coverage_tolerance", sql("SELECT ticker, round(2 * sqrt(0.9 * 0.1 / count(*)), 8) AS tolerance FROM records WHERE model = 'engine' GROUP BY 1"))(lambda s, d: records(s, d).where("model = 'engine'").groupBy("ticker").agg(evaluate.coverage_tolerance(F.lit(0.9), F.count(F.lit(1))).alias("tolerance")))
query("eval_base_rate_brier", sql("SELECT ticker, round(avg((rate - up) ** 2), 8) AS base_rate_brier FROM (SELECT ticker, up, coalesce(avg(up) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.5) AS rate FROM (SELECT ticker, date, CASE WHEN realized > 0 THEN 1.0 ELSE 0.0 END AS up FROM records WHERE model = 'engine')) GROUP BY 1"))(lambda s, d: evaluate.base_rate_brier(records(s, d)))
PER_YEAR = 248 / 5
RISK_FREE = 1.065 ** (1 / PER_YEAR) - 1
RULE = {
    "held": "SELECT ticker, date, exp(realized) - 1 AS stock, CASE WHEN p_up >= 0.55 THEN 1 ELSE 0 END AS i FROM records WHERE model = 'engine'",
    "switched": "SELECT *, abs(i - coalesce(lag(i) OVER (PARTITION BY ticker ORDER BY date), 0)) AS sw FROM held",
    "ruled": f"SELECT ticker, date, 'rule' AS strategy, CASE WHEN i = 1 THEN stock ELSE {RISK_FREE!r} END - sw * 0.0025 / 2 AS r, stock, i, sw FROM switched UNION ALL SELECT ticker, date, 'buy_and_hold', stock, stock, 1, 0 FROM switched",
    "wealth": "SELECT *, sum(ln(1 + r)) OVER (PARTITION BY ticker, strategy ORDER BY date) AS lw FROM ruled",
    "peaked": "SELECT *, max(lw) OVER (PARTITION BY ticker, strategy ORDER BY date) AS top FROM wealth",
    "performed": f"SELECT ticker, strategy, exp(sum(ln(1 + r)) * {PER_YEAR} / count(*)) - 1 AS annual_return, stddev_samp(r) * sqrt({PER_YEAR}) AS annual_volatility, CASE WHEN stddev_samp(r) > 0 THEN (avg(r) - {RISK_FREE!r}) / stddev_samp(r) * sqrt({PER_YEAR}) ELSE 0.0 END AS sharpe_ratio, min(exp(lw - top) - 1) AS max_drawdown, exp(sum(ln(1 + r))) - 1 - CASE WHEN strategy = 'rule' THEN 0 ELSE 0.0025 END AS total_return, avg(CAST(i AS DOUBLE)) AS share_invested, CASE WHEN strategy = 'rule' THEN sum(sw) ELSE 1 END AS trades, CASE WHEN strategy = 'rule' THEN avg(CASE WHEN stock > 0 THEN 1.0 ELSE 0.0 END) FILTER (i = 1) END AS hit_rate FROM peaked GROUP BY 1, 2",
}
PERF = r8("annual_return", "annual_volatility", "sharpe_ratio", "max_drawdown", "total_return", "share_invested", "hit_rate")
query("eval_long_only_rule", sql(f"SELECT ticker, strategy, CAST(trades AS BIGINT) AS trades, {PERF} FROM performed", **RULE))(lambda s, d: evaluate.long_only_rule(records(s, d), SETTINGS))
query("eval_performance", sql(f"SELECT ticker, {r8('annual_return', 'annual_volatility', 'sharpe_ratio', 'max_drawdown', 'total_return + 0.0025 AS total_return')} FROM performed WHERE strategy = 'buy_and_hold'", **RULE))(lambda s, d: evaluate.performance(records(s, d).where("model = 'engine'").withColumn("stock", F.expm1("realized")), "stock", PER_YEAR, RISK_FREE))
query("bt_chosen_models", sql("SELECT ticker, date, position, coalesce(best, CASE WHEN has THEN 'garch_t' ELSE 'gbm' END) AS chosen FROM (SELECT ticker, date, position, arg_min(model, m * 1000000 + k) FILTER (known >= 20) AS best, bool_or(model = 'garch_t') AS has FROM (SELECT *, count(crps) OVER w AS known, avg(crps) OVER w AS m, CASE model WHEN 'gbm' THEN 1 WHEN 'garch_t' THEN 2 ELSE 4 END * 1e-9 AS k FROM records WHERE model <> 'engine' WINDOW w AS (PARTITION BY ticker, model ORDER BY position RANGE BETWEEN UNBOUNDED PRECEDING AND 5 PRECEDING)) GROUP BY 1, 2, 3)"))(lambda s, d: evaluate.chosen_models(records(s, d), 5, 20, "garch_t"))
query("syn_best_model", sql("SELECT ticker, arg_min(model, m) AS chosen FROM (SELECT ticker, model, avg(crps) AS m FROM records WHERE model <> 'engine' GROUP BY 1, 2) GROUP BY 1"))(lambda s, d: evaluate.best_model(evaluate.skills(records(s, d), LEVELS), "garch_t"))


def _verdicts(s: SparkSession, d: str) -> DataFrame:
    scored = full_records(s, d)
    return evaluate.verdicts(evaluate.compare_models(scored, LEVELS), evaluate.long_only_rule(scored, SETTINGS), SETTINGS)


ALPHA = SETTINGS["evaluation"]["significance_level"]
_within = " AND ".join(f"abs(coverage_{round(100 * v)} - {v}) <= 2 * sqrt({v} * (1 - {v}) / forecasts)" for v in LEVELS)
query(
    "out_verdicts",
    full_sql(sql(
        f"SELECT c.ticker, forecasts AS forecasts_tested, pit_ks_p >= {ALPHA} AND {_within} AS calibrated, {r8('pit_ks_p')}, crps_skill > 0 AND crps_dm_p < {ALPHA} AS distribution_edge, {r8('crps_skill', 'crps_dm_p')}, brier_skill > 0 AND brier_dm_p < {ALPHA} AS directional_edge, {r8('brier_skill', 'brier_dm_p')}, p.beats AS rule_beats_buy_and_hold FROM compared c JOIN (SELECT ticker, max(sharpe_ratio) FILTER (strategy = 'rule') > max(sharpe_ratio) FILTER (strategy = 'buy_and_hold') AS beats FROM performed GROUP BY 1) p USING (ticker) WHERE model = 'engine'",
        **RULE,
    )),
)(_verdicts)


# ---- whole plans ---------------------------------------------------------------------------

#: The walk-forward and live forecast of the registered queries: the engine's own settings, nothing reduced.
PLAN = load_settings()


def prepared(s: SparkSession, d: str) -> DataFrame:
    return walkforward.prepare(bars(s, d), earnings(s, d), PLAN)


def _live(s: SparkSession, d: str) -> DataFrame:
    from .plans.live import live_forecast

    ready = durable(prepared(s, d))
    tested, _ = walkforward.walk_forward(ready, PLAN)
    chosen = evaluate.best_model(evaluate.skills(tested, LEVELS), "garch_t")
    out = live_forecast(ready, earnings(s, d), chosen, fundamentals.fair_value(scores(s, d), FUND), PLAN)
    return out.select("ticker", "as_of", "last_close", "volatility_model", F.size("samples").alias("paths"), "posterior_mean", "posterior_sd", "training_rows")


query("bt_prepare", sql(f"SELECT j.ticker, j.date, CAST(f.position AS INTEGER) AS position, {r8('f.x AS x', 'f.realized AS forward', 'CASE WHEN a.raw IS NOT NULL THEN CASE WHEN a.raw > 25 THEN 1.0 ELSE 0.0 END END AS trending')}, d.date IS NOT NULL AS reaction, {r8(*[f'j.{n} AS {n}' for n in PRIORITY])} FROM ({joined_sql(PRIORITY)}) j JOIN fits f ON f.ticker = j.ticker AND f.date = j.date JOIN ({ADX}) a ON a.ticker = j.ticker AND a.date = j.date LEFT JOIN reacting d ON d.ticker = j.ticker AND d.date = j.date"))(prepared)
query("bt_walk_forward")(lambda s, d: walkforward.walk_forward(prepared(s, d), PLAN)[0])
query("bt_refit_log")(lambda s, d: walkforward.candidates(prepared(s, d), PLAN, "serial").where("note IS NOT NULL").select("ticker", "date", "refit", "note"))
query("syn_live_forecast")(_live)
BARS_OF_EVENTS = "SELECT event_type AS ticker, CAST(date_trunc('hour', ts) AS VARCHAR) AS bar_start, min_by(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, max_by(value, (ts, event_id)) AS close, CAST(count(value) AS DOUBLE) AS volume FROM events GROUP BY 1, 2"


def _event_bars(s: SparkSession, d: str) -> DataFrame:
    from .streaming.bars import intraday_bars

    return intraday_bars(s.read.parquet(f"{d}/events.parquet"))


query("stream_intraday_bars", BARS_OF_EVENTS)(_event_bars)


def _model_state(s: SparkSession, d: str) -> DataFrame:
    """The bars streamed through fixed fits, their mean return taken beforehand."""
    from .streaming.model_state import replay

    listed = lambda v: F.array(*[listed(x) if isinstance(x, list) else F.lit(float(x)) for x in v])
    held = dict(zip(("omega", "alpha", "gamma", "beta"), GARCH, strict=True)) | dict(zip(("start", "transition", "means", "variances"), STATES, strict=True)) | dict(zip(("level_variance", "observation_ratio", "slope_ratio"), TREND, strict=True))
    fits = returns(s, d).groupBy("ticker").agg(F.avg("r").alias("mean")).select("ticker", "mean", *[(listed(v) if isinstance(v, list) else F.lit(float(v))).alias(k) for k, v in held.items()])
    out = replay(bars(s, d).select("ticker", C("date").cast("timestamp").alias("at"), "close"), fits)
    return out.select("ticker", C("at").cast("date").alias("date"), "close", "variance", "turbulent", F.round("slope_z", 5).alias("slope_z"))


query(
    "stream_model_state",
    sql(
        f"SELECT ticker, date, {r8('close', 'g.v AS variance', 'h.p1 AS turbulent')}, round(CASE WHEN position >= 2 THEN k.tilt / sqrt(k.b * {_l}) END, 5) + 0.0 AS slope_z FROM rets r LEFT JOIN (SELECT ticker, position, v FROM path WHERE k > 0) g USING (ticker, position) LEFT JOIN (SELECT ticker, position, p1 FROM filt) h USING (ticker, position) LEFT JOIN (SELECT ticker, position, tilt, b FROM kal) k USING (ticker, position)",
        **garch_parts(*GARCH),
        **REGIME_PARTS,
        **TREND_PARTS,
    ),
)(_model_state)


def _resume_work(s: SparkSession, d: str) -> DataFrame:
    """The origins that a kept test has to run again: forty days came in, and one old bar of AF changed."""
    from .plans import resume

    now = returns(s, d).select("ticker", "date", "position", "x")
    held = now.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("ticker"))).where("position < n - 40").drop("n")
    held = held.withColumn("x", F.when((C("ticker") == "AF") & (C("position") == 600), C("x") + 0.01).otherwise(C("x")))
    kept = resume.keys(held, PLAN, ["x"])
    return resume.keys(now, PLAN, ["x"]).join(kept, resume.KEY, "left_anti").select("ticker", "refit", "position")


_EVERY = -(-SETTINGS["walk_forward"]["refit_every_days"] // STEP) * STEP
query("bt_resume_work", sql(f"SELECT ticker, CAST(floor((position - {FIRST}) / {_EVERY}) AS BIGINT) AS refit, CAST(position AS INTEGER) AS position FROM origins WHERE position >= n - 40 - {HORIZON} OR (ticker = 'AF' AND position + {HORIZON} >= 600)"))(_resume_work)


def _evidence_posterior(s: SparkSession, d: str) -> DataFrame:
    """Y1 and Y3 with all seven pieces of evidence; the composites take every indicator, the trend fixed noise."""
    rows = durable(posterior.evidence(prepared(s, d), filters.trend_strength(returns(s, d), *TREND), MEMBERS))
    return posterior.drift_posteriors(rows, horizon=HORIZON, prior_mean=PRIOR[0], prior_sd=PRIOR[1], effect_sd=EFFECT)


EFFECT = SETTINGS["bayes"]["signal_effect_prior_sd"]
_each = lambda form: "[" + ", ".join(form.format(k=k) for k in range(1, 8)) + "]"
_mean = {c: "(" + " + ".join(f"j.{n}" for n in ns) + f") / {len(ns)}" for c, ns in MEMBERS.items()}
_on = "CASE WHEN a.raw IS NOT NULL THEN CASE WHEN a.raw > 25 THEN 1.0 ELSE 0.0 END END"
_own = f"CASE WHEN z = 0 THEN {1 / PRIOR[1] ** 2!r} WHEN z % 10 = 0 THEN {1 / EFFECT**2!r} WHEN z IN (8, 72) THEN {PRIOR[0] / PRIOR[1] ** 2!r} ELSE 0.0 END"
_today = "[1.0] || list_transform(range(1, 8), lambda k: CASE WHEN u.used[k] THEN coalesce((o.e[k] - p.mid[k]) / p.sd[k], 0.0) ELSE 0.0 END)"
EVIDENCE_PARTS = TREND_PARTS | {
    "normal_values": RHO["normal_values"],
    "adx_values": ADX,
    "ev": f"SELECT f.ticker, f.position, f.realized AS forward, [{', '.join(_mean.values())}, CASE WHEN k.position >= 2 THEN k.tilt / sqrt(k.b * {_l}) END, {_mean['trend']} * {_on}, {_mean['momentum']} * {_on}] AS e FROM normal_values j JOIN fits f ON f.ticker = j.ticker AND f.date = j.date JOIN adx_values a ON a.ticker = j.ticker AND a.date = j.date LEFT JOIN kal k ON k.ticker = f.ticker AND k.position = f.position",
    "told": "SELECT *, max(position) OVER (PARTITION BY ticker) AS origin FROM ev",
    "earlier": f"SELECT * FROM told WHERE position % {HORIZON} = origin % {HORIZON} AND position <= origin - {HORIZON}",
    "usable": "SELECT ticker, " + _each("coalesce(count(e[{k}]) >= 30 AND stddev_samp(e[{k}]) > 1e-12, false)") + " AS used FROM earlier GROUP BY 1",
    "complete": "SELECT b.*, u.used FROM earlier b JOIN usable u ON u.ticker = b.ticker WHERE forward IS NOT NULL AND len(list_filter(range(1, 8), lambda k: u.used[k] AND b.e[k] IS NULL)) = 0",
    "placed": "SELECT ticker, count(*) AS outcomes, var_samp(forward) AS v, " + _each("avg(e[{k}])") + " AS mid, " + _each("stddev_samp(e[{k}])") + " AS sd FROM complete GROUP BY 1",
    "vectors": "SELECT c.ticker, 0 AS cap, [1.0] || list_transform(range(1, 8), lambda k: CASE WHEN c.used[k] THEN (c.e[k] - p.mid[k]) / p.sd[k] ELSE 0.0 END) || [forward] AS v FROM complete c JOIN placed p ON p.ticker = c.ticker",
    "gram": _gram_sql("vectors", 9),
    "solving": f"SELECT g.ticker, CAST(0 AS BIGINT) AS k, list_transform(range(0, 81), lambda z: CASE WHEN z = 80 THEN 0.0 ELSE g.m[z + 1] / p.v + {_own} END) AS m FROM gram g JOIN placed p ON p.ticker = g.ticker UNION ALL SELECT ticker, k + 1, {_swept_sql('m', 'k', 9)} FROM solving WHERE k < 8",
    "now": f"SELECT o.ticker, p.outcomes, u.used, s.m, {_today} AS t FROM told o JOIN usable u ON u.ticker = o.ticker JOIN placed p ON p.ticker = o.ticker JOIN solving s ON s.ticker = o.ticker AND s.k = 8 WHERE o.position = o.origin AND p.outcomes >= 20",
}
query(
    "syn_drift_posterior_evidence",
    sql(
        f"SELECT ticker, outcomes, {r8('list_sum(list_transform(range(0, 8), lambda i: m[i * 9 + 9] * t[i + 1])) AS mean', 'sqrt(list_sum(list_transform(range(0, 64), lambda z: -m[(z // 8) * 9 + z % 8 + 1] * t[z // 8 + 1] * t[z % 8 + 1]))) AS sd', 'm[9] AS baseline', *[f'CASE WHEN used[{k}] THEN m[{9 * k + 9}] * t[{k + 1}] END AS {c}' for k, c in enumerate(posterior.EVIDENCE, 1)])} FROM now",
        **EVIDENCE_PARTS,
    ),
)(_evidence_posterior)
