"""Inputs the given tables do not hold: huge ids, late trades, bad rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickerloom.functions import labels
from tickerloom.operators import bars, indicators, market
from tickerloom.operators import ledger as L

TRADES = "user_id bigint, trade_id bigint, ts timestamp, symbol string, side string, quantity double, price double"


def buys(spark, ids, day=1):
    rows = [(1, i, dt.datetime(2026, 1, day + n), "A", "BUY", 1.0, 10.0) for n, i in enumerate(ids)]
    return spark.createDataFrame(rows, TRADES)


@pytest.fixture
def start(spark):
    return spark.createDataFrame([(1, 1000.0)], "user_id bigint, balance double")


def test_large_trade_ids_survive(spark, start):
    ids = [2 ** 60 + 1, 2 ** 60 + 3]
    got = L.replay_trades(buys(spark, ids), start).filter("trade_id IS NOT NULL").select("trade_id").collect()
    assert sorted(r.trade_id for r in got) == ids


def test_state_after_periods_is_the_last_one(spark, start, tmp_path):
    ledger = L.replay_by_period(spark, buys(spark, range(1, 7)), start, "day", str(tmp_path / "l"))
    assert L.balances(ledger).first().balance == 940 and L.open_positions(ledger).first().quantity == 6


def test_late_trades_and_new_users_are_not_lost(spark, start, tmp_path):
    path = str(tmp_path / "l")
    L.replay_by_period(spark, buys(spark, [1, 2, 3]), start, "day", path).count()
    more = buys(spark, [1, 2, 3]).unionByName(buys(spark, [9])).unionByName(
        spark.createDataFrame([(2, 20, dt.datetime(2026, 1, 2), "B", "BUY", 1.0, 10.0)], TRADES))
    users = start.unionByName(spark.createDataFrame([(2, 50.0)], "user_id bigint, balance double"))
    ledger = L.replay_by_period(spark, more, users, "day", path)
    assert {r.user_id: r.balance for r in L.balances(ledger).collect()} == {1: 960, 2: 40}


def test_trades_without_time_are_rejected(spark, start, tmp_path):
    rows = buys(spark, [1]).unionByName(spark.createDataFrame([(1, 2, None, "A", "BUY", 1.0, 10.0)], TRADES))
    ledger = L.replay_by_period(spark, rows, start, "day", str(tmp_path / "l"))
    assert {r.trade_id: r.reject_reason for r in ledger.filter("trade_id IS NOT NULL").collect()} == {1: None, 2: "missing_time"}


def test_bad_candles_do_not_stop_a_read(spark):
    rows = [("A", "2026-01-02", "1", "2", "0.5", "12abc", "7"), ("A", "not a date", "1", "2", "1", "3", "7"),
            ("A", "2026-13-45", "1", "2", "1", "3", "7"), ("A", "2026-01-03", "x", "NaN", "1", "NaN", None),
            ("A", "2026-01-04", "1", "2", "1", "3", None)]
    raw = spark.createDataFrame(rows, "symbol string, date string, open string, high string, low string, close string, volume string")
    got = bars.clean_candles(raw, F.lit("2026-01-05").cast("timestamp"), 30).orderBy("date").collect()
    assert [(str(r.date), r.close, r.volume) for r in got] == [("2026-01-02", 12.0, 7), ("2026-01-04", 3.0, 0)]


def test_zero_prices_do_not_stop_a_pass(spark, make_bars):
    df = make_bars({"A": [1.0] * 30}).withColumns({"low": F.lit(0.0)})
    assert indicators.enrich(df, ("returns", "bands", "volatility"), keys=("symbol",)).count() == 30
    zero = make_bars({"A": [0.0, 1.0]})
    assert market.daily_quotes(zero).first().percent_change is None


@pytest.mark.parametrize(("text", "want"), [
    ("February 27, 2026", dt.datetime(2026, 2, 27)), ("Feb 27, 2026 11:56 PM", dt.datetime(2026, 2, 27, 23, 56)),
    ("Feb 27, 2026", dt.datetime(2026, 2, 27)), ("nothing", None)])
def test_month_first_dates(spark, text, want):
    got = spark.range(1).select(labels.parse_date(F.lit(text)).alias("d")).first().d
    assert got == want
