"""Rule-based trade plan from a technical snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.numbers import dollars

NO_DATA = "Neutral (No Data)"


def _two(c: Column) -> Column:
    return F.round(c, 2)


def interpretation_table(price: Column, rsi: Column, macd: Column, signal: Column, sma200: Column,
                         sma20: Column) -> Column:
    """Four rows of indicator, reading and interpretation."""
    mood = (
        F.when(rsi < 30, "Oversold (Buy Signal)").when(rsi < 45, "Approaching Oversold")
        .when(rsi > 70, "Overbought (Sell Signal)").when(rsi > 55, "Momentum Building").otherwise("Neutral")
    )
    cross = F.when(macd > signal, "Bullish Cross").otherwise("Bearish Cross")
    level = lambda sma, up, down: F.when(price > sma, up).otherwise(down)
    row = lambda name, reading, text: F.struct(
        F.lit(name).alias("indicator"), reading.alias("reading"), text.alias("interpretation"))
    return F.array(
        row("RSI (14-Day)", F.format_string("%.2f", rsi), mood),
        row("MACD", F.format_string("%.2f / %.2f", macd, signal), cross),
        row("SMA 200", dollars(sma200), level(sma200, "Long-term Support", "Long-term Resistance")),
        row("SMA 20", dollars(sma20), level(sma20, "Immediate Support", "Immediate Resistance")),
    )


def trade_plan(technicals: DataFrame) -> DataFrame:
    """Plan columns for rows(symbol, current_price, rsi, macd, macd_signal, sma_20, sma_200[, sentiment, pe_ratio])."""
    have = technicals.columns
    price = F.coalesce("current_price", F.lit(0.0))
    rsi = F.coalesce("rsi", F.lit(50.0))
    macd, signal = F.coalesce("macd", F.lit(0.0)), F.coalesce("macd_signal", F.lit(0.0))
    sma20, sma200 = F.coalesce("sma_20", F.lit(0.0)), F.coalesce("sma_200", F.lit(0.0))
    sentiment = F.coalesce("sentiment", F.lit(0.0)) if "sentiment" in have else F.lit(0.0)
    pe = F.col("pe_ratio") if "pe_ratio" in have else F.lit(None).cast("double")

    uptrend, above20 = price > sma200, price > sma20
    trend = F.when(uptrend, "Uptrend").otherwise("Downtrend")
    short_term = F.when(above20, "Bullish").otherwise("Bearish/Consolidation")

    swing = F.when(~above20, "Sell / Avoid").when(rsi < 35, "Buy Dip").otherwise("Weak Sell / Avoid")
    dip = above20 & (rsi < 35)
    # %s of a rounded double shows the shortest decimals, as in "$98.0".
    trigger = F.when(~above20, F.format_string("Break below $%s", _two(price * 0.98).cast("string"))).when(
        dip, F.format_string("Limit Buy at $%s", _two(price).cast("string")))
    target = F.when(~above20, _two(price * 0.94)).when(dip, _two(sma20))
    stop = F.when(~above20, _two(price * 1.02)).when(dip, _two(price * 0.96))

    gather = uptrend & (rsi < 40)
    high_pe = F.when(pe > 60, " Valuation is high (Growth Premium).").otherwise("")
    action = F.when(gather, "ACCUMULATE").otherwise("WAIT / HOLD")
    reason = F.when(gather, "Long term trend is up and price is pulling back.").otherwise(
        F.concat(F.lit("Volatile market conditions."), high_pe))
    zone = _two(sma200 * 1.02)

    score = (
        F.when(uptrend, 20).otherwise(0) + F.when(macd > signal, 20).otherwise(0)
        + F.when((rsi > 40) & (rsi < 60), 10).when(rsi < 30, 15).otherwise(0)
        + F.when(sentiment > 0.1, 20).when(sentiment < -0.1, -20).otherwise(0)
    )
    bull = F.least(F.greatest(score, F.lit(10)), F.lit(80)) + 10
    share = lambda c: F.bround(c * F.lit(0.75)).cast("int")

    has_price = price != 0
    only = lambda c: F.when(has_price, c)
    text = lambda c: F.coalesce(c.cast("string"), F.lit("N/A"))
    return technicals.select(
        "symbol",
        F.when(has_price, F.coalesce(trigger, F.lit("Wait"))).otherwise("N/A").alias("entry"),
        text(only(stop)).alias("stop_loss"),
        text(only(target)).alias("take_profit"),
        F.when(has_price, swing).otherwise(NO_DATA).alias("signal"),
        F.when(has_price, F.concat(short_term, F.lit(" within "), trend)).otherwise("N/A").alias("trend_status"),
        F.when(has_price, interpretation_table(price, rsi, macd, signal, sma200, sma20)).otherwise(
            F.array().cast("array<struct<indicator:string,reading:string,interpretation:string>>")
        ).alias("technical_table"),
        only(F.struct(
            F.struct(
                action.alias("action"), reason.alias("reason"),
                F.format_string("$%s - $%s", zone.cast("string"), _two(zone * 1.05).cast("string")).alias("entry_zone"),
                F.lit("18-24 months").alias("target"),
            ).alias("conservative"),
            F.struct(
                swing.alias("action"),
                F.when(trigger.isNotNull(), F.struct(
                    F.when(above20, "Bullish").otherwise("Bearish").alias("type"), trigger.alias("trigger"),
                    target.alias("target"), stop.alias("stop_loss"))).alias("setup"),
            ).alias("swing"),
        )).alias("scenarios"),
        only(share(bull)).alias("bull_case"),
        only(share(100 - bull)).alias("bear_case"),
        only(F.lit(25)).alias("neutral_case"),
    )
