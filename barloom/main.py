"""Command line (O7): analyse tickers of a folder of bars and print their reports."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.clean import load_bars
from .plans.live import analyse, write_reports
from .settings import load_settings
from .sources import files, fixtures


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="barloom", description=__doc__)
    p.add_argument("tickers", nargs="*", help="tickers to report; all of the bars are analysed")
    p.add_argument("--csv", help="folder of CSV bars, a file for each ticker")
    p.add_argument("--testdata", help="folder of the test tables, where there are no bars")
    p.add_argument("--fundamentals", help="folder of earnings, statements and multiples")
    p.add_argument("--settings", help="YAML file of settings")
    p.add_argument("--indices", help="folder of CSV closes of the indices, a file for each index")
    p.add_argument("--sectors", help="CSV file of ticker, sector")
    p.add_argument("--cache", help="folder that keeps cleaned bars between runs")
    p.add_argument("--refresh", action="store_true", help="do not read the cache")
    p.add_argument("--keep", help="shared folder that keeps the walk-forward test, so that a rerun adds new origins alone")
    p.add_argument("--mode", choices=("parallel", "serial"), default="parallel")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("barloom").getOrCreate()
    settings = load_settings(args.settings)
    now = datetime.now()
    if args.csv:
        load = lambda: load_bars(files.read_csv(spark, args.csv), settings, now)
    elif args.testdata:
        load = lambda: fixtures.walk_bars(spark, args.testdata)
    else:
        p.error("--csv or --testdata is needed")
    start = now - timedelta(days=366 * settings["data"]["history_years"])
    options = {"source": args.csv or args.testdata}
    bars = files.cached(spark, load, args.cache, "bars", start=start, options=options, max_age_hours=settings["data"]["cache"]["max_age_hours"], now=now, refresh=args.refresh) if args.cache else load()
    if args.tickers:
        bars = bars.where(F.col("ticker").isin(args.tickers))
    found = files.read_fundamentals(spark, args.fundamentals) if args.fundamentals else {"earnings": fixtures.announcements(bars), "statements": fixtures.statements(bars), "multiples": fixtures.multiples(bars)}
    peers = spark.createDataFrame([(t, q) for t, qs in settings["fundamentals"]["peers"].items() for q in qs], "ticker string, peer string")
    benchmark, sector = indices(spark, args.indices, args.sectors, settings) if args.indices else (None, None)
    print(f"analysing the bars of {bars.select('ticker').distinct().count()} tickers", file=sys.stderr)
    a = analyse(bars, found["earnings"], found["statements"], found["multiples"], peers, benchmark, sector, settings, args.mode, args.keep)
    for r in write_reports(a, settings).select("report").orderBy("ticker").limit(20).toLocalIterator():
        sys.stdout.write(r["report"] + "\n")


def indices(spark: SparkSession, folder: str, sectors: str | None, settings: dict) -> tuple[DataFrame | None, DataFrame | None]:
    """The benchmark's closes (date, close) and, for each ticker with a known sector, those of its
    sector's index (ticker, date, close); None, with a warning, for what is not there."""

    def closes() -> DataFrame:
        raw = files.read_csv(spark, folder)
        of = {c.strip().lower(): c for c in raw.columns}
        when = next(of[n] for n in ("date", "datetime", "timestamp") if n in of)
        return raw.select("ticker", F.to_date(F.col(f"`{when}`")).alias("date"), F.col(f"`{of['close']}`").cast("double").alias("close")).where("close IS NOT NULL AND date IS NOT NULL")

    market = settings["market"]
    held = files.optional(closes, "index data")
    if held is None:
        return None, None
    benchmark = held.where(F.col("ticker") == market["benchmark_index"]).select("date", "close")
    if not benchmark.limit(1).count():
        return None, None
    of = files.optional(lambda: spark.read.csv(sectors, header=True).select("ticker", "sector"), "sectors") if sectors else None
    if of is None:
        return benchmark, None
    named = spark.createDataFrame(list(market["sector_indices"].items()), "sector string, ix string")
    own = of.join(F.broadcast(named), "sector").select(F.col("ticker").alias("t"), "ix")
    return benchmark, held.withColumnRenamed("ticker", "ix").join(own, "ix").select(F.col("t").alias("ticker"), "date", "close")


if __name__ == "__main__":
    main()
