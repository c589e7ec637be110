"""Screener responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUOTE = (
    "struct<symbol:string,shortName:string,longName:string,regularMarketPrice:double,regularMarketChange:double,"
    "regularMarketChangePercent:double,regularMarketVolume:double,marketCap:double,fullExchangeName:string,"
    "exchange:string>"
)
RESPONSE_SCHEMA = f"finance struct<result:array<struct<quotes:array<{QUOTE}>>>>"


def normalize_screener(responses: DataFrame, asof: Column, body: str = "body") -> DataFrame:
    """Quote rows of the first result of each JSON response."""
    parsed = responses.select(F.from_json(body, RESPONSE_SCHEMA).alias("r"))
    quotes = F.get("r.finance.result", 0)["quotes"]
    rows = parsed.select(F.posexplode(quotes).alias("pos", "q"))
    text = lambda *names: [F.nullif(F.col(f"q.{n}"), F.lit("")) for n in names]
    zero = lambda n: F.coalesce(f"q.{n}", F.lit(0.0))
    return rows.select(
        "pos", F.col("q.symbol").alias("symbol"),
        F.coalesce(*text("shortName", "longName"), F.lit("")).alias("name"),
        zero("regularMarketPrice").alias("current_price"),
        zero("regularMarketChange").alias("change"),
        zero("regularMarketChangePercent").alias("percent_change"),
        zero("regularMarketVolume").cast("bigint").alias("volume"),
        zero("marketCap").alias("market_cap"),
        F.coalesce(*text("fullExchangeName", "exchange"), F.lit("N/A")).alias("exchange"),
        asof.alias("datetime"),
        (zero("regularMarketChange") >= 0).alias("is_up"),
    )


def read_screener(spark: SparkSession, path: str, asof: Column | None = None) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).withColumnRenamed("value", "body")
    return normalize_screener(raw, F.current_timestamp() if asof is None else asof)
