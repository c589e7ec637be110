"""Market tables: movers, most active, volume days, lookups, universe, quote shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_movers(quotes: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest gains and the ``k`` largest losses by percent change."""
    shape = lambda df, kind: df.select(
        F.lit(kind).alias("kind"), F.col("symbol").alias("ticker"), F.col("current_price").alias("price"),
        "percent_change", F.concat(F.col("percent_change").cast("string"), F.lit("%")).alias("change"),
        F.col("change").alias("change_amount"), "volume")
    known = quotes.filter(F.col("percent_change").isNotNull())
    up = known.orderBy(F.desc("percent_change"), "symbol").limit(k)
    down = known.orderBy(F.asc("percent_change"), "symbol").limit(k)
    return shape(up, "gainer").unionByName(shape(down, "loser"))


def top_losers(quotes: DataFrame, k: int = 10) -> DataFrame:
    return top_movers(quotes, k).filter(F.col("kind") == "loser")


def most_active(quotes: DataFrame, k: int = 25) -> DataFrame:
    return quotes.orderBy(F.desc("volume"), "symbol").limit(k)


def top_volume_days(bars: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` days of largest volume of every symbol; the map tasks cut to ``k`` already."""
    w = Window.partitionBy("symbol").orderBy(F.desc("volume"), F.desc("date"))
    return bars.select("symbol", "date", "volume").withColumn("place", F.row_number().over(w)).filter(
        F.col("place") <= k)


def symbol_lookup(listings: DataFrame, symbol: str) -> DataFrame:
    return listings.filter(F.upper("symbol") == symbol.upper())


def symbol_search(listings: DataFrame, keyword: str) -> DataFrame:
    word = F.lit(keyword.lower())
    return listings.filter(F.contains(F.lower("symbol"), word) | F.contains(F.lower("name"), word))


def merge_universe(*screeners: DataFrame) -> DataFrame:
    """Symbol to name over all screeners; a later screener wins."""
    rows = None
    for i, df in enumerate(screeners):
        part = df.filter(F.coalesce("symbol", F.lit("")) != "").select("symbol", "name", F.lit(i).alias("_o"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("symbol").agg(F.max_by("name", "_o").alias("name")).orderBy("symbol")


def prefer(*candidates: DataFrame) -> DataFrame:
    """The first candidate that has any row."""
    for df in candidates[:-1]:
        if not df.isEmpty():
            return df
    return candidates[-1]


def daily_quotes(bars: DataFrame, asof: Column | None = None) -> DataFrame:
    """Quote per symbol on ``asof``, or on its latest day: last close, change against the close before, volume.

    The two latest closes come from mergeable aggregates, so a long history needs no
    window.
    """
    upto = bars if asof is None else bars.filter(F.col("date") <= asof)
    last = upto.groupBy("symbol").agg(
        F.max_by("close", "date").alias("current_price"), F.max("date").alias("_last"),
        F.max_by("volume", "date").alias("volume"))
    before = upto.join(last.select("symbol", "_last"), "symbol").filter(F.col("date") < F.col("_last")).groupBy(
        "symbol").agg(F.max_by("close", "date").alias("previous_close"))
    change = F.col("current_price") - F.col("previous_close")
    return last.join(before, "symbol", "left").select(
        "symbol", F.col("_last").alias("date"), "current_price", "previous_close", change.alias("change"),
        (change / F.nullif(F.col("previous_close"), F.lit(0.0)) * 100).alias("percent_change"), "volume",
        F.coalesce(change >= 0, F.lit(True)).alias("is_up"),
    )


# Numeric quote fields that read as 0 when absent, and text fields with their default.
QUOTE_ZERO_FIELDS = [
    "current_price", "change", "percent_change", "previous_close", "open", "volume", "trailing_pe", "forward_pe",
    "peg_ratio", "price_to_sales", "price_to_book", "enterprise_value_to_revenue", "enterprise_value_to_ebitda",
    "diluted_eps", "bid", "ask", "beta", "book_value", "dividend_rate", "dividend_yield", "market_cap",
    "average_volume", "fifty_day_average", "two_hundred_day_average", "target_mean_price",
]
QUOTE_TEXT_DEFAULTS = {
    "exchange": "N/A",
    "currency": "USD",
    "recommendation_key": "N/A",
}


def shape_quote(quotes: DataFrame) -> DataFrame:
    """Defaults of the quote output for whichever fields are present, and ``is_up``."""
    zero = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
            for c in QUOTE_ZERO_FIELDS if c in quotes.columns}
    text = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d))
            for c, d in QUOTE_TEXT_DEFAULTS.items() if c in quotes.columns}
    out = quotes.withColumns({**zero, **text}) if zero or text else quotes
    if "name" in quotes.columns:
        out = out.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.col("symbol")))
    return out.withColumn("is_up", F.col("change") >= 0) if "change" in quotes.columns else out
