"""Rolling, lagged and exponentially weighted columns over (ticker, date)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY, ORDER = "ticker", "date"


def ordered() -> WindowSpec:
    return Window.partitionBy(KEY).orderBy(ORDER)


def last_rows(n: int) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return ordered().rowsBetween(-(n - 1), 0)


def so_far() -> WindowSpec:
    return ordered().rowsBetween(Window.unboundedPreceding, 0)


def lag(x: Column | str, k: int = 1) -> Column:
    return F.lag(x, k).over(ordered())


def diff(x: Column, k: int = 1) -> Column:
    return x - lag(x, k)


def rolling(aggregate: Column, counted: Column | str, n: int, least: int | None = None) -> Column:
    """An aggregate over the last n rows; null where fewer than `least` (default n) values are there."""
    return F.when(F.count(counted).over(last_rows(n)) >= (n if least is None else least), aggregate.over(last_rows(n)))


def bounded(x: Column, centre: float, half: float) -> Column:
    """Linear about the centre, clipped to -1..1; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (x - centre) / half)))


def by_trailing_std(x: Column, n: int) -> Column:
    """Tanh of the value over its trailing standard deviation; half a window suffices."""
    return F.tanh(x / F.nullif(rolling(F.stddev_samp(x), x, n, n // 2), F.lit(0.0)))


def tanh_scaled(x: Column, scale: float) -> Column:
    """N3."""
    return F.tanh(x / scale)


def trailing_percentile(x: Column, n: int) -> Column:
    """Place among the last n rows, ties half, mapped to -1..1. Rows of the frame without a
    value count in the denominator; half a window of values suffices."""
    frame = last_rows(n)
    held = F.collect_list(x).over(frame)
    below = F.size(F.filter(held, lambda v: v < x))
    equal = F.size(F.filter(held, lambda v: v == x))
    share = (below + 0.5 * (equal - 1)) / F.nullif(F.count(F.lit(1)).over(frame) - 1, F.lit(0))
    return F.when(x.isNotNull() & (F.count(x).over(frame) >= n // 2), 2 * share - 1)


def decaying_sum(df: DataFrame, value: Column, keep: float, name: str) -> DataFrame:
    """Adds y = value + keep * y before it (0 before the first value), and <name>_n, the number of the
    value from 0; both null before the first value. Later nulls are not allowed.

    Weights grow from the start of each block of rows, never over the whole series, so a series may
    have any length. A block is as long as it takes a weight to fall below a double's precision,
    whatever `keep` is; what a block inherits is then the sum of the block before, all that still
    weighs. Four windows over one shuffle.
    """
    if not 0 < keep < 1:
        raise ValueError("keep must be between 0 and 1")
    block = math.ceil(40 / -math.log(keep))
    n, x, b, s, e = f"{name}_n", *(f"__{name}_{k}" for k in "xbse")
    out = df.withColumn(x, value)
    out = out.withColumn(n, F.when(F.col(x).isNotNull(), F.count(x).over(so_far()) - 1))
    out = out.withColumn(b, F.floor(F.col(n) / block))
    place = F.col(n) - F.col(b) * block
    inside = Window.partitionBy(KEY, b).orderBy(ORDER).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn(s, F.pow(F.lit(keep), place) * F.sum(F.col(x) * F.pow(F.lit(keep), -place)).over(inside))
    out = out.withColumn(e, F.sum(F.when(place == block - 1, F.col(s))).over(Window.partitionBy(KEY).orderBy(b).rangeBetween(-1, -1)))
    return out.withColumn(name, F.col(s) + F.coalesce(F.col(e), F.lit(0.0)) * F.pow(F.lit(keep), place + 1)).drop(x, b, s, e)


def ewm(df: DataFrame, value: Column, alpha: float, name: str, least: int = 0) -> DataFrame:
    """Adds the exponentially weighted mean y = alpha * x + (1 - alpha) * y before it, started by
    the first value; null before it and while fewer than `least` values are there. Any alpha up to 1."""
    if alpha >= 1:
        return df.withColumn(name, F.when(F.count(value).over(so_far()) >= max(least, 1), value))
    x, y, n = f"__{name}_v", f"__{name}_y", f"__{name}_y_n"
    out = df.withColumn(x, value)
    first = F.count(x).over(so_far()) == 1
    out = decaying_sum(out, F.when(first, F.lit(1.0)).otherwise(F.lit(alpha)) * F.col(x), 1 - alpha, y)
    return out.withColumn(name, F.when(F.col(n) >= max(least, 1) - 1, F.col(y))).drop(x, y, n)


def wilder(df: DataFrame, value: Column, period: int, name: str) -> DataFrame:
    """Exponential average of weight 1 / period, after `period` values."""
    return ewm(df, value, 1 / period, name, period)
