"""Price bars: cleaning, building from ticks, coarser intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.numbers import parse_float

# Interval names and the calendar unit each one is cut by.
INTERVAL_UNITS = {
    "1h": "hour",
    "1d": "day",
    "1wk": "week",
    "1mo": "month",
}

BAR_COLUMNS = ["symbol", "date", "open", "high", "low", "close", "volume"]


def valid_close(close: str | Column = "close") -> Column:
    """A close that is a number above zero."""
    c = F.col(close) if isinstance(close, str) else close
    return c.isNotNull() & ~F.isnan(c) & (c > 0)


def clean_candles(raw: DataFrame, asof: Column | None = None, days: int | None = 30) -> DataFrame:
    """Cast raw candle rows, keep the last ``days`` days, drop unusable dates and closes.

    A malformed date drops its row; of a text the leading number counts.
    """
    asof = F.current_timestamp() if asof is None else asof
    date = F.col("date").try_cast("date")
    if days is not None:
        raw = raw.filter(F.col("date").try_cast("timestamp") >= asof - F.make_dt_interval(F.lit(days)))
    number = lambda c: parse_float(F.col(c).cast("string"))
    rows = raw.select(
        "symbol",
        date.alias("date"),
        *[number(c).alias(c) for c in ("open", "high", "low", "close")],
        F.coalesce(F.floor(number("volume")).cast("bigint"), F.lit(0)).alias("volume"),
    )
    return rows.filter(F.col("date").isNotNull() & valid_close("close"))


def bars_from_ticks(
    ticks: DataFrame, unit: str, order: Sequence[str], keys: Sequence[str] = ("symbol",), ts: str = "ts"
) -> DataFrame:
    """Open/high/low/close/volume bars; partial aggregates do most work before the shuffle.

    ``order`` must be unique within a bar.  A single number, such as a tick sequence,
    lets the aggregate run in a hash map; several columns make it sort.
    """
    start = F.date_trunc(unit, F.col(ts))
    if unit in ("day", "week", "month"):
        start = start.cast("date")
    at = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return ticks.groupBy(*keys, start.alias("date")).agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("volume").cast("bigint").alias("volume"),
    )


def resample(bars: DataFrame, interval: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Coarser bars keyed by the first day of the week (Monday) or month."""
    start = F.date_trunc(INTERVAL_UNITS[interval], F.col("date"))
    if interval != "1h":
        start = start.cast("date")
    return bars.groupBy(*keys, start.alias("_start")).agg(
        F.min_by("open", "date").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "date").alias("close"),
        F.sum("volume").cast("bigint").alias("volume"),
    ).withColumnRenamed("_start", "date")


def all_intervals(daily: DataFrame) -> DataFrame:
    """Daily, weekly and monthly bars in long form with an ``interval`` column."""
    parts = [daily.select(F.lit("1d").alias("interval"), *BAR_COLUMNS)]
    for name in ("1wk", "1mo"):
        parts.append(resample(daily, name).select(F.lit(name).alias("interval"), *BAR_COLUMNS))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
