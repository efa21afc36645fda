"""Bars and fundamentals made of the test tables, where there are no market prices.

`line_bars` are raw trades of lineitem (prices without memory); `walk_bars` a random walk driven by
each day's mean price, the default for models; `rev_bars` a mean-reverting series. A ticker is a
return flag with a line status. Prices are rounded to four decimals, as quotes are (a
3e-8 is added first, so that no product stands exactly between two of them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat("l_returnflag", "l_linestatus").alias("ticker"), F.col("l_shipdate").cast("date").alias("date"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


def line_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, highest, lowest, last unit price and the quantity of each day."""
    rows = lines(spark, sf_dir).withColumns({"price": F.round(F.col("l_extendedprice") / F.col("l_quantity") + 3e-8, 4), "at": F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")})
    return rows.groupBy("ticker", "date").agg(F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.sum("l_quantity").alias("volume"))


def daily(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    rows = lines(spark, sf_dir)
    rows = rows.withColumn("ticker", F.lit("ALL")) if whole else rows
    day = rows.groupBy("ticker", "date").agg(F.avg("l_extendedprice").alias("p"), F.sum("l_quantity").alias("volume"))
    every = Window.partitionBy("ticker")
    return day.withColumn("z", (F.col("p") - F.avg("p").over(every)) / F.stddev_pop("p").over(every))


def from_closes(closes: DataFrame) -> DataFrame:
    """Bars about a close series: open is the close before, high and low stand off by the day."""
    w = Window.partitionBy("ticker").orderBy("date")
    nth = F.row_number().over(w)
    day = closes.select("ticker", "date", "close", "volume", F.coalesce(F.lag("close").over(w), F.col("close")).alias("open"), nth.alias("n"))
    high = F.round(F.greatest("open", "close") * (1 + (F.col("n") % 7 + 1) * 0.001) + 3e-8, 4)
    low = F.round(F.least("open", "close") * (1 - (F.col("n") % 5 + 1) * 0.001) + 3e-8, 4)
    return day.select("ticker", "date", "open", high.alias("high"), low.alias("low"), "close", "volume")


def walk_bars(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    close = F.round(100 * F.exp(F.sum(0.01 * F.col("z") + 0.0003).over(w)), 4)
    return from_closes(daily(spark, sf_dir, whole).select("ticker", "date", close.alias("close"), "volume"))


def rev_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log price falls back to its mean by 3 % a day."""
    order = Window.partitionBy("ticker").orderBy("date")
    numbered = daily(spark, sf_dir).withColumn("i", (F.row_number().over(order) - 1) % 2000)
    keep = 0.97
    part = Window.partitionBy("ticker", "block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    numbered = numbered.withColumn("block", F.floor((F.row_number().over(order) - 1) / 2000))
    x = F.pow(F.lit(keep), F.col("i")) * F.sum(0.01 * F.col("z") * F.pow(F.lit(keep), -F.col("i"))).over(part)
    return from_closes(numbered.select("ticker", "date", F.round(100 * F.exp(x), 4).alias("close"), "volume"))


def announcements(bars: DataFrame) -> DataFrame:
    """Quarterly results of each ticker: fifteen days after a quarter's end, at 10:00 and 17:00
    exchange time in turn (04:30 and 11:30 UTC); EPS is a tenth of the quarter's mean close, the
    estimate that of the quarter before."""
    quarter = bars.groupBy("ticker", F.trunc("date", "quarter").alias("q")).agg(F.round(F.avg("close") / 10, 2).alias("reported_eps"))
    w = Window.partitionBy("ticker").orderBy("q")
    nth = F.row_number().over(w)
    end = F.date_add(F.add_months("q", 3), 14)
    at = F.to_timestamp(F.concat(end.cast("string"), F.when(nth % 2 == 1, F.lit(" 04:30:00")).otherwise(F.lit(" 11:30:00"))))
    out = quarter.select("ticker", at.alias("announced_at"), F.lag("reported_eps").over(w).alias("eps_estimate"), "reported_eps")
    return out.withColumn("surprise_pct", F.round(100 * (F.col("reported_eps") / F.col("eps_estimate") - 1), 4))


def statements(bars: DataFrame) -> DataFrame:
    """Income statements in long form: revenue is the traded value, net income a tenth of it less a
    tenth of the volume; yearly and quarterly."""
    out = None
    for freq, unit, months in (("annual", "year", 12), ("quarterly", "quarter", 3)):
        period = bars.groupBy("ticker", F.date_add(F.add_months(F.trunc("date", unit), months), -1).alias("period_end")).agg(F.round(F.sum(F.col("close") * F.col("volume")), 2).alias("revenue"), F.sum("volume").alias("v"))
        long = period.select("ticker", F.lit(freq).alias("freq"), "period_end", F.explode(F.array(F.struct(F.lit("Total Revenue").alias("line_item"), F.col("revenue").alias("value")), F.struct(F.lit("Net Income").alias("line_item"), F.round(F.col("revenue") * 0.1 - F.col("v") * 0.1, 2).alias("value")))).alias("x")).select("ticker", "freq", "x.line_item", "period_end", "x.value")
        out = long if out is None else out.unionAll(long)
    return out


def multiples(bars: DataFrame) -> DataFrame:
    """Valuation multiples of each ticker, from its last close; one of six is implausible."""
    last = bars.groupBy("ticker").agg(F.max_by("close", "date").alias("c"), F.max_by("volume", "date").alias("v"))
    pe, pb, ev = F.round(10 + F.col("c") % 30, 2), F.round(1 + F.col("v") % 9, 2), F.when(F.col("ticker") == "AO", F.lit(900.0)).otherwise(F.round(5 + F.col("c") % 20, 2))
    return last.select("ticker", F.explode(F.array(*[F.struct(F.lit(n).alias("multiple"), x.alias("value")) for n, x in (("trailingPE", pe), ("priceToBook", pb), ("enterpriseToEbitda", ev))])).alias("x")).select("ticker", "x.*")
