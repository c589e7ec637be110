"""Candle files and portfolio tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.operators.bars import clean_candles

_CANDLE = "date string, open string, high string, low string, close string, volume string"
CANDLE_FILE_SCHEMA = f"symbol string, {_CANDLE}, historical array<struct<{_CANDLE.replace(' string', ':string')}>>"

# Schemas of the portfolio tables.
PORTFOLIO_SCHEMAS = {
    "users": "user_id bigint, name string, email string, balance double, initial_capital double",
    "holdings": "user_id bigint, symbol string, side string, quantity double, avg_cost double",
    "transactions": "user_id bigint, trade_id bigint, ts timestamp, symbol string, type string, quantity double, "
                    "price double, total_cost double, status string, entry_price double, realized_pnl double",
    "watchlist": "user_id bigint, symbol string, added_at timestamp",
    "snapshots": "user_id bigint, date date, equity double, balance double, unrealized_pnl double, "
                 "realized_pnl double",
}

# Balance and capital of a user who has none recorded.
START_BALANCE = 100000.0


def read_candles(spark: SparkSession, path: str, days: int | None = 30, asof: Column | None = None,
                 multi_line: bool = True) -> DataFrame:
    """Candles of JSON files holding a bare array of rows or an object with a ``historical`` array.

    Without a ``symbol`` field the file name (before the first dot) is the symbol.
    ``multi_line`` false reads one document per line instead of one per file.
    """
    raw = spark.read.schema(CANDLE_FILE_SCHEMA).option("multiLine", multi_line).json(path)
    fields = [c.split()[0] for c in _CANDLE.split(", ")]
    rows = F.coalesce("historical", F.array(F.struct(*fields)))
    stem = F.upper(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1))
    flat = raw.select(F.coalesce("symbol", stem).alias("symbol"), F.inline(rows))
    return clean_candles(flat, asof, days)


def read_portfolio_table(spark: SparkSession, path: str, name: str, user_id: int | None = None) -> DataFrame:
    """One portfolio table with its fixed schema; the user filter reaches the scan."""
    df = spark.read.schema(PORTFOLIO_SCHEMAS[name]).parquet(path)
    if name == "users":
        df = df.fillna(START_BALANCE, ["balance", "initial_capital"])
    return df if user_id is None else df.filter(F.col("user_id") == user_id)


def write_portfolio_table(df: DataFrame, path: str, name: str, mode: str = "overwrite") -> None:
    """Write a portfolio table; snapshots are split by month of their date."""
    columns = [c.split()[0] for c in PORTFOLIO_SCHEMAS[name].split(", ")]
    out = df.select(*[c for c in columns if c in df.columns])
    writer = out.write.mode(mode)
    if name == "snapshots":
        out = out.withColumn("month", F.date_format("date", "yyyy-MM"))
        writer = out.write.mode(mode).partitionBy("month").option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
