import datetime as dt

from pyspark.sql import functions as F

from tickerloom.operators import bars as B
from tickerloom.operators import market as M


def test_weeks_start_on_monday_and_months_on_the_first(make_bars):
    bars = make_bars({"A": [10, 12, 9, 11, 14, 13, 8, 20]}, start=dt.date(2024, 2, 28))  # a Wednesday
    week = {r["date"]: r for r in B.resample(bars, "1wk").collect()}
    assert set(week) == {dt.date(2024, 2, 26), dt.date(2024, 3, 4)}
    first = week[dt.date(2024, 2, 26)]
    assert first["close"] == 14 and first["high"] == 14 * 1.02 and first["low"] == 9 * 0.97
    month = {r["date"]: r for r in B.resample(bars, "1mo").collect()}
    assert month[dt.date(2024, 2, 1)]["close"] == 12 and month[dt.date(2024, 3, 1)]["close"] == 20
    for r in [*week.values(), *month.values()]:
        assert r["high"] >= max(r["open"], r["close"]) and r["low"] <= min(r["open"], r["close"])


def test_all_intervals(make_bars):
    rows = B.all_intervals(make_bars({"A": range(1, 61)})).groupBy("interval").count().collect()
    assert {r["interval"]: r["count"] for r in rows} == {"1d": 60, "1wk": 9, "1mo": 3}


def test_clean_candles(spark):
    raw = spark.createDataFrame(
        [("A", "2024-01-05", "1", "2", "0.5", "1.5", "10"), ("A", "2024-01-06", "1", "2", "0.5", "0", "10"),
         ("A", "2024-01-07", "1", "2", "0.5", "NaN", None), ("A", "2024-01-08", "x", "2", "0.5", "3", None),
         ("A", "2023-01-01", "1", "2", "0.5", "4", "10")],
        "symbol string, date string, open string, high string, low string, close string, volume string")
    rows = B.clean_candles(raw, F.lit("2024-01-10").cast("timestamp"), 30).orderBy("date").collect()
    assert [(str(r["date"]), r["open"], r["close"], r["volume"]) for r in rows] == [
        ("2024-01-05", 1.0, 1.5, 10), ("2024-01-08", None, 3.0, 0)]


def test_ticks_tie_by_order(spark):
    ticks = spark.createDataFrame(
        [("A", dt.datetime(2024, 1, 1, 9), 2, 5.0, 1), ("A", dt.datetime(2024, 1, 1, 9), 1, 4.0, 1),
         ("A", dt.datetime(2024, 1, 1, 10), 3, 6.0, 2)], "symbol string, ts timestamp, seq bigint, price double, volume bigint")
    for order in (("ts", "seq"), ("seq",)):
        r = B.bars_from_ticks(ticks, "day", order).first()
        assert (r["open"], r["high"], r["low"], r["close"], r["volume"]) == (4.0, 6.0, 4.0, 6.0, 4)


def test_market_tables(spark, make_bars):
    bars = make_bars({"A": [10, 11, 12], "B": [10, 9, 8], "C": [5]})
    q = {r["symbol"]: r for r in M.daily_quotes(bars, F.lit("2001-01-02").cast("date")).collect()}
    assert q["A"]["current_price"] == 11 and q["A"]["percent_change"] == 10.0 and q["C"]["change"] is None
    quotes = M.daily_quotes(bars, F.lit("2002-01-01").cast("date"))
    movers = [(r["kind"], r["ticker"]) for r in M.top_movers(quotes, 1).collect()]
    assert movers == [("gainer", "A"), ("loser", "B")]
    assert [r["ticker"] for r in M.top_losers(quotes, 2).collect()] == ["B", "A"]
    assert M.most_active(quotes, 2).count() == 2
    assert M.top_volume_days(bars, 2).groupBy("symbol").count().filter("count > 2").count() == 0
    universe = M.merge_universe(
        spark.createDataFrame([("B", "old"), ("", "x")], "symbol string, name string"),
        spark.createDataFrame([("B", "new"), ("A", "a")], "symbol string, name string"))
    assert [tuple(r) for r in universe.collect()] == [("A", "a"), ("B", "new")]
    empty = spark.createDataFrame([], "symbol string")
    assert M.prefer(empty, empty, spark.createDataFrame([("Z",)], "symbol string")).first()["symbol"] == "Z"
    shaped = M.shape_quote(spark.createDataFrame(
        [("A", None, None, -1.0, "")], "symbol string, name string, open double, change double, exchange string")).first()
    assert (shaped["name"], shaped["open"], shaped["is_up"], shaped["exchange"]) == ("A", 0.0, False, "N/A")
