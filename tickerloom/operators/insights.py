"""One insight document per ticker, and the forecast attached to a quote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assemble_insights(universe: DataFrame, asof: Column, fundamentals: DataFrame | None = None,
                      technicals: DataFrame | None = None, plans: DataFrame | None = None,
                      news: DataFrame | None = None) -> DataFrame:
    """Left joins from the universe; a ticker missing in one section keeps the others.

    Every section has one row per ``ticker``; ``news(ticker, news_count, news_summary)``.
    """
    out = universe.select("ticker")
    sections = {"fundamentals": fundamentals, "technicals": technicals, "trade_report": plans}
    for name, df in sections.items():
        if df is None:
            out = out.withColumn(name, F.lit(None).cast("string"))
            continue
        fields = [c for c in df.columns if c != "ticker"]
        out = out.join(df.select("ticker", F.struct(*fields).alias(name)), "ticker", "left")
    if news is None:
        out = out.withColumns({"news_count": F.lit(None).cast("bigint"), "news_summary": F.lit(None).cast("string")})
    else:
        out = out.join(news.select("ticker", "news_count", "news_summary"), "ticker", "left")
    sentiment = F.struct(F.lit("Neutral").alias("verdict"), F.lit(0.0).alias("overall_score"))
    return out.select(
        "ticker", asof.alias("last_updated"), *sections,
        F.coalesce("news_summary", F.lit("No recent news found.")).alias("news_summary"),
        F.coalesce("news_count", F.lit(0)).alias("news_count"),
        sentiment.alias("sentiment"),
    )


def join_forecast(quotes: DataFrame, forecast_text: DataFrame) -> DataFrame:
    """Attach the forecast of each symbol; an empty map without one."""
    empty = F.create_map().cast("map<string,struct<bull_case:string,neutral_case:string,bear_case:string>>")
    return quotes.join(forecast_text, "symbol", "left").withColumn(
        "forecast_3day", F.coalesce("forecast_3day", empty))
