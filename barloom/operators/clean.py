"""Raw bars to contract bars.

Contract: ticker string, date date, open, high, low, close, volume double; one row for each ticker
and date; no nulls; prices above 0, volume 0 or more, low <= open, close <= high.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")
VALUES = (*PRICES, "volume")


class InvalidBars(ValueError):
    """Bars break the contract."""


class InsufficientHistory(ValueError):
    """Fewer years of bars than asked for."""


def renamed(raw: DataFrame) -> DataFrame:
    """Contract columns by names of any letter case; raises for missing ones."""
    of = {c.strip().lower(): c for c in raw.columns}
    when = next((n for n in ("date", "datetime", "timestamp") if n in of), None)
    missing = [c for c in VALUES if c not in of] + ["date"] * (when is None)
    if missing:
        raise InvalidBars(f"missing columns: {', '.join(missing)}")
    return raw.select(F.col(f"`{of['ticker']}`").alias("ticker") if "ticker" in of else F.lit("").alias("ticker"), F.col(f"`{of[when]}`").cast("date").alias("date"), *[F.col(f"`{of[c]}`").cast("double").alias(c) for c in VALUES], F.col(f"`{of['ingest_seq']}`").alias("ingest_seq") if "ingest_seq" in of else F.monotonically_increasing_id().alias("ingest_seq"))


def last_of_each_day(bars: DataFrame) -> DataFrame:
    """Of rows of one ticker and date the one that came last."""
    return bars.groupBy("ticker", "date").agg(F.max_by(F.struct(*VALUES), "ingest_seq").alias("x")).select("ticker", "date", "x.*")


def complete(bars: DataFrame) -> DataFrame:
    """Rows without a missing value; NaN counts as missing."""
    return bars.where(F.col("date").isNotNull()).where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in VALUES))


def body() -> tuple[Column, Column]:
    return F.greatest("open", "close"), F.least("open", "close")


def repaired(bars: DataFrame) -> DataFrame:
    """High and low drawn out to the body."""
    top, bottom = body()
    return bars.withColumns({"high": F.greatest("high", top), "low": F.least("low", bottom)})


def violation() -> Column:
    """By how much high and low miss the body, as a share of it."""
    top, bottom = body()
    return F.greatest((top - F.col("high")) / top, (F.col("low") - bottom) / bottom, F.lit(0.0))


def standardise(raw: DataFrame, tolerance: float) -> DataFrame:
    """Contract columns, one row a day (the last), no missing values, small breaks of
    high and low mended; raises InvalidBars for prices of 0 or less and for larger breaks."""
    bars = complete(last_of_each_day(renamed(raw)))
    checks = bars.agg(F.count_if(F.least(*PRICES) <= 0).alias("low"), F.count_if(violation() > tolerance).alias("broken"), F.min(F.when(violation() > tolerance, F.col("date"))).alias("first")).first()
    if checks["low"]:
        raise InvalidBars(f"{checks['low']} bars have a price of 0 or less")
    if checks["broken"]:
        raise InvalidBars(f"{checks['broken']} bars have a high or low off their body by more than {tolerance:.2%}, the first on {checks['first']}")
    return repaired(bars)


def drop_placeholders(bars: DataFrame) -> DataFrame:
    """Holiday rows, flat and without volume, go."""
    flat = (F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == F.col("close"))
    return bars.where(~(flat & (F.col("volume") == 0)))


def drop_unfinished(bars: DataFrame, now: datetime, exchange_timezone: str) -> DataFrame:
    """D3: rows of the exchange's today and later go. `now` is UTC."""
    return bars.where(F.col("date") < F.to_date(F.from_utc_timestamp(utc(now), exchange_timezone)))


def utc(moment: datetime, timezone: str = "UTC") -> Column:
    """A naive moment of a time zone, or an aware one, as a UTC timestamp column."""
    from datetime import timezone as tz

    if moment.tzinfo is not None:
        moment, timezone = moment.astimezone(tz.utc).replace(tzinfo=None), "UTC"
    return F.to_utc_timestamp(F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz").cast("timestamp"), timezone)


def trim_history(bars: DataFrame, now: datetime, years: float) -> DataFrame:
    return bars.where(F.col("date") >= F.lit(now.date().isoformat()).cast("date") - F.make_interval(years=F.lit(int(years))))


def problems(bars: DataFrame) -> DataFrame:
    """For each ticker how many rows break each rule of the contract."""
    top, bottom = body()
    repeated = bars.groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("n")).groupBy("ticker").agg(F.sum(F.col("n") - 1).alias("repeated_dates"))
    missing = F.expr(" OR ".join(f"{c} IS NULL OR isnan({c})" for c in VALUES))
    counts = bars.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(missing).alias("missing_values"),
        F.count_if(F.least(*PRICES) <= 0).alias("prices_not_positive"),
        F.count_if(F.col("volume") < 0).alias("negative_volume"),
        F.count_if((F.col("high") < top) | (F.col("low") > bottom)).alias("body_outside_range"),
    )
    return counts.join(repeated, "ticker")


def validate(bars: DataFrame) -> DataFrame:
    """The bars, or InvalidBars naming every broken rule."""
    found = problems(bars)
    kinds = [c for c in found.columns if c not in ("ticker", "rows")]
    sums = found.agg(F.sum("rows").alias("rows"), *[F.sum(k).alias(k) for k in kinds]).first()
    bad = [f"{k}: {sums[k]}" for k in kinds if sums[k]]
    if not sums["rows"]:
        raise InvalidBars("no bars")
    if bad:
        raise InvalidBars("; ".join(bad))
    return bars


def spans(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg((F.datediff(F.max("date"), F.min("date")) / 365.25).alias("years"))


def ensure_history(bars: DataFrame, years: float) -> DataFrame:
    """Raises InsufficientHistory if a ticker spans fewer years."""
    short = spans(bars).where(F.col("years") < years).orderBy("years").limit(5).collect()
    if short:
        raise InsufficientHistory(", ".join(f"{r['ticker']} has {r['years']:.1f} years" for r in short) + f"; {years} are needed")
    return bars


def load_bars(raw: DataFrame, settings: dict, now: datetime) -> DataFrame:
    """Standardise, drop placeholders, trim, validate, check the span; the order matters."""
    data = settings["data"]
    bars = standardise(raw, data["ohlc_repair_tolerance"])
    if data["drop_holiday_placeholder_bars"]:
        bars = drop_placeholders(bars)
    return ensure_history(validate(trim_history(bars, now, data["history_years"])), data["min_history_years"])


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
