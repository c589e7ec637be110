"""Written results: signals, forecasts, insights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions.numbers import percent_text, percent_value


def write_signals_csv(signals: DataFrame, path: str) -> None:
    signals.write.mode("overwrite").option("header", True).csv(path)


def read_signals_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_forecast(rows: DataFrame, path: str) -> None:
    """One JSON line per (ticker, date) with the cases as percent texts."""
    rows.select("ticker", "date", *[percent_text(c).alias(f"{c}_case") for c in ("bull", "neutral", "bear")]) \
        .write.mode("overwrite").json(path)


def read_forecast(spark: SparkSession, path: str) -> DataFrame:
    """Shares (0 to 1) per ticker and date."""
    raw = spark.read.schema("ticker string, date date, bull_case string, neutral_case string, bear_case string").json(path)
    return raw.select("ticker", "date", *[(percent_value(f"{c}_case") / 100).alias(c)
                                          for c in ("bull", "neutral", "bear")])


def forecast_map(rows: DataFrame) -> DataFrame:
    """Per symbol a map of its few forecast dates to percent texts."""
    cases = F.struct(*[percent_text(c).alias(f"{c}_case") for c in ("bull", "neutral", "bear")])
    entry = F.struct(F.date_format("date", "yyyy-MM-dd").alias("key"), cases.alias("value"))
    return rows.groupBy(F.col("ticker").alias("symbol")).agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("forecast_3day"))


def write_insights(insights: DataFrame, path: str) -> None:
    """One JSON line per ticker under the run's date; a rerun of a date replaces only that date."""
    dated = insights.withColumn("run_date", F.to_date("last_updated"))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").json(path)


def lookup_insight(insights: DataFrame, ticker: str) -> DataFrame:
    """The row of a ticker in any letter case; no row when it is not found."""
    return insights.filter(F.upper("ticker") == ticker.upper())
