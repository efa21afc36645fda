"""Bars and fundamentals from files, and their cache."""

from __future__ import annotations

import json
import logging
import re
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import trim_history

C = F.col
log = logging.getLogger(__name__)
EARNINGS = "ticker string, announced_at timestamp, eps_estimate double, reported_eps double, surprise_pct double"
STATEMENTS = "ticker string, freq string, line_item string, period_end date, value double"
MULTIPLES = "ticker string, multiple string, value double"
FUNDAMENTALS = {"earnings": EARNINGS, "statements": STATEMENTS, "multiples": MULTIPLES}


class SourceError(RuntimeError):
    """A source has no usable data."""


def read_csv(spark: SparkSession, folder: str) -> DataFrame:
    """All CSV files of a folder, the file's name without .csv being the ticker; columns in any
    order and letter case, one of them date, datetime or timestamp."""
    raw = spark.read.csv(f"{folder.rstrip('/')}/*.csv", header=True, inferSchema=False)
    if not {c.strip().lower() for c in raw.columns} & {"date", "datetime", "timestamp"}:
        raise SourceError(f"{folder} has no date column")
    return raw.withColumn("ticker", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """D1's stand-in where there is no network: bars kept as Parquet."""
    return spark.read.parquet(path)


def safe_name(ticker: str, interval: str = "1d") -> str:
    """D12."""
    return f"{re.sub('[^A-Za-z0-9._^-]', '_', ticker)}_{interval}"


def usable(meta: dict, *, start: datetime, options: dict, max_age_hours: float, now: datetime) -> bool:
    """Young enough, fetched with the same options, from that start or an earlier one."""
    try:
        fetched, since = datetime.fromisoformat(meta["fetched_at"]), datetime.fromisoformat(meta["start"])
    except (KeyError, ValueError):
        return False
    return now - fetched <= timedelta(hours=max_age_hours) and meta.get("options") == options and since <= start


def write_cache(bars: DataFrame, folder: str, name: str, *, start: datetime, options: dict, now: datetime) -> None:
    """All bars anew as Parquet, and how they came about as JSON beside it."""
    bars.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    meta = json.dumps({"fetched_at": now.isoformat(), "start": start.isoformat(), "options": options})
    bars.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}.meta")


def read_cache(spark: SparkSession, folder: str, name: str, *, start: datetime, options: dict, max_age_hours: float, now: datetime) -> DataFrame | None:
    """Cached bars, or None if there are none that are usable."""
    try:
        meta = json.loads(spark.read.text(f"{folder}/{name}.meta").first()["value"])
        bars = spark.read.parquet(f"{folder}/{name}.parquet")
    except Exception as e:  # noqa: BLE001  whatever keeps a cache from being read, it is fetched anew
        log.info("no cache for %s: %s", name, str(e)[:80])
        return None
    return bars if usable(meta, start=start, options=options, max_age_hours=max_age_hours, now=now) else None


def cached(spark: SparkSession, fetch, folder: str, name: str, *, start: datetime, options: dict, max_age_hours: float, now: datetime, refresh: bool = False) -> DataFrame:
    """From the cache, else fetched (a function without arguments) and cached whole."""
    found = None if refresh else read_cache(spark, folder, name, start=start, options=options, max_age_hours=max_age_hours, now=now)
    if found is None:
        write_cache(fetch(), folder, name, start=start, options=options, now=now)
        found = spark.read.parquet(f"{folder}/{name}.parquet")
    return trim_history(found, now, (now - start).days / 365.25 + 1)


def read_fundamentals(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a folder; one that is missing is empty and does not keep the others back."""
    out = {}
    for name, schema in FUNDAMENTALS.items():
        try:
            out[name] = spark.read.schema(schema).parquet(f"{folder}/{name}.parquet")
        except Exception as e:  # noqa: BLE001
            log.warning("no %s: %s", name, str(e)[:80])
            out[name] = spark.createDataFrame([], schema)
    return out


def to_json(table: DataFrame) -> DataFrame:
    """Rows as JSON text, keyed by ticker."""
    return table.select("ticker", F.to_json(F.struct(*table.columns), {"ignoreNullFields": "false"}).alias("json"))


def from_json(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(F.from_json("json", FUNDAMENTALS[name]).alias("x")).select("x.*")


def optional(load, what: str):
    """What `load` gives, or None with a warning."""
    try:
        return load()
    except Exception as e:  # noqa: BLE001
        log.warning("%s is not available: %s", what, str(e)[:80])
        return None
