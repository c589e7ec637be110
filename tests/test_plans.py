"""Physical plans: what must be cut, pruned or pushed before a shuffle."""

import datetime as dt

from pyspark.sql import functions as F

from tickerloom.operators import indicators as I
from tickerloom.operators import ledger as L
from tickerloom.operators import market as M
from tickerloom.operators import news as N
from tickerloom.plans import views as V
from tickerloom.plans.stored import stored

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_cut_in_the_map_tasks(spark):
    bars = V.eod(spark, SF)
    scored = spark.createDataFrame([(1, "T", "earnings", 3)], "id bigint, ticker string, category string, score int")
    texts = V.news(spark, SF)
    for df in (M.top_volume_days(bars), N.category_quotas(scored), N.note_context(texts),
               L.recent_transactions(V.trades(spark, SF), 5), N.cap_per_key(texts, "ticker", 60, [F.asc("id")])):
        assert "WindowGroupLimit" in plan(df)
    assert "TakeOrderedAndProject" in plan(N.headline_words(texts)) and "TakeOrderedAndProject" in plan(M.most_active(scored.withColumnRenamed("score", "volume").withColumnRenamed("ticker", "symbol")))


def test_scans_are_pruned_and_filters_pushed(spark):
    text = plan(V.eod(spark, SF).select("symbol", "date", "high"))
    assert "l_tax" not in text and "l_discount" not in text and "p_name" not in text
    bars = stored(V.eod(spark, SF), "eod")
    sma = plan(I.enrich(bars, ("sma",), sma_periods=(20,)).select("symbol", "sma20"))
    assert "volume" not in sma.split("FileScan")[1] and "open" not in sma.split("FileScan")[1]
    late = plan(bars.filter(F.col("date") >= F.lit(dt.date(2000, 1, 1))))
    assert "GreaterThanOrEqual(date,2000-01-01)" in late


def test_one_shuffle_and_sort_serves_all_indicators_of_a_block(spark):
    text = plan(I.enrich(stored(V.eod(spark, SF), "eod"), ("sma", "bands", "atr", "volume_spike", "volatility")))
    assert text.count("Exchange hashpartitioning(symbol") <= 4
    assert "SinglePartition" not in text


def test_dedup_moves_keys_only_and_joins_on_the_ordinal(spark):
    text = plan(N.dedup_title(V.table(spark, SF, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("title"), "source")))
    assert "LeftSemi" in text and "partial_min(id" in text
