import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickerloom.operators import ledger as L
from tickerloom.operators import portfolio as P

T0 = dt.datetime(2024, 1, 1)
TRADES = "user_id bigint, trade_id bigint, ts timestamp, symbol string, side string, quantity double, price double"


def trades(spark, rows):
    """rows of (user, symbol, side, qty, price), one minute apart."""
    data = [(u, i, T0 + dt.timedelta(minutes=i), s, side, float(q), float(p)) for i, (u, s, side, q, p) in enumerate(rows)]
    return spark.createDataFrame(data, TRADES)


def users(spark, **balances):
    return spark.createDataFrame([(int(u[1:]), float(b)) for u, b in balances.items()], "user_id bigint, balance double")


def run(spark, rows, **balances):
    ledger = L.replay_trades(trades(spark, rows), users(spark, **balances))
    return ledger, {r["trade_id"]: r for r in ledger.filter("status <> 'OPENING'").collect()}


def test_buys_average_and_sells_realize(spark):
    ledger, by = run(spark, [(1, "AAPL", "BUY", 10, 150), (1, "AAPL", "BUY", 10, 200), (1, "AAPL", "SELL", 5, 180),
                             (1, "AAPL", "SELL", 15, 190)], u1=100000)
    assert (by[1]["position_after"], by[1]["avg_cost_after"]) == (20, 175)
    assert (by[2]["position_after"], by[2]["realized_pnl"], by[2]["entry_price"]) == (15, 25, 175)
    assert by[3]["realized_pnl"] == 225 and by[3]["balance_after"] == 100250
    assert L.open_positions(ledger).count() == 0
    tx = L.transactions(ledger)
    assert tx.count() == 4 and L.recent_transactions(tx, 2).count() == 2 and L.recent_transactions(tx, 0).count() == 4
    assert [r["trade_id"] for r in L.recent_transactions(tx, 2).orderBy("n").collect()] == [3, 2]
    day = L.realized_pnl_by_day(ledger).first()
    assert (day["realized_pnl"], day["exits"]) == (250, 2)


def test_short_and_cover(spark):
    _, by = run(spark, [(1, "X", "SHORT", 1, 100), (1, "X", "COVER", 1, 90)], u1=1000)
    assert [by[i]["balance_after"] for i in (0, 1)] == [900, 1010] and by[1]["realized_pnl"] == 10


def test_reject_reasons_and_their_order(spark):
    _, by = run(spark, [
        (1, "A", "BUY", 1, 100), (1, "A", "SHORT", 1, 10), (1, "A", "SHORT", 100, 100), (1, "A", "SELL", 2, 10),
        (1, "B", "SELL", 1, 10), (1, "B", "SHORT", 1, 10), (1, "B", "BUY", 1, 10), (1, "B", "COVER", 2, 1),
        (1, "A", "COVER", 1, 1), (1, "A", "HOLD", 1, 1), (1, "A", "BUY", 0, 1), (2, "A", "BUY", 1, 1)], u1=200)
    assert [by[i]["reject_reason"] for i in range(12)] == [
        None, "opposite_position", "insufficient_funds", "insufficient_quantity", "no_position", None,
        "opposite_position", "insufficient_quantity", "no_position", "invalid_side", "missing_field", "user_not_found"]
    assert by[11]["balance_after"] is None and by[10]["balance_after"] == 90


def test_absent_fields(spark):
    rows = [(1, 1, T0, None, "BUY", 1.0, 1.0), (1, 2, T0, "A", "", 1.0, 1.0), (1, 3, T0, "A", "BUY", None, 1.0),
            (1, 4, T0, "A", "BUY", 1.0, float("nan")), (1, 5, T0, "A", "BUY", 1.0, 2.0)]
    df = spark.createDataFrame(rows, TRADES)
    by = {r["trade_id"]: r for r in L.replay_trades(df, users(spark, u1=10)).filter("status <> 'OPENING'").collect()}
    assert [by[i]["reject_reason"] for i in range(1, 6)] == ["missing_field"] * 4 + [None] and by[5]["balance_after"] == 8


def _random_rows(n=400, seed=1):
    rnd = random.Random(seed)
    # User 1 makes most of the trades.
    return [(rnd.choice([1, 1, 1, 2, 3]), rnd.choice("XYZ"), rnd.choice(L.SIDES), rnd.randint(1, 5), rnd.randint(1, 40))
            for _ in range(n)]


def test_cash_is_conserved(spark):
    """Balance plus cost of open positions equals the start plus realized profit."""
    ledger, _ = run(spark, _random_rows(), u1=500, u2=500, u3=500)
    cost = {r[0]: r[1] for r in L.open_positions(ledger).groupBy("user_id").agg(F.sum(F.col("quantity") * F.col("avg_cost"))).collect()}
    gain = {r[0]: r[1] for r in ledger.groupBy("user_id").agg(F.sum("realized_pnl")).collect()}
    for r in L.balances(ledger).collect():
        u = r["user_id"]
        assert r["balance"] + cost.get(u, 0) == pytest.approx(500 + (gain.get(u) or 0))


def test_periods_and_resumed_state_give_the_same_ledger(spark, tmp_path):
    rows = _random_rows(300, 5)
    df, start = trades(spark, rows), users(spark, u1=500, u2=500, u3=500)
    columns = ["trade_id", "status", "reject_reason", "realized_pnl", "balance_after", "position_after"]
    whole = sorted(L.replay_trades(df, start).filter("status <> 'OPENING'").select(columns).collect(), key=lambda r: r[0])
    cut = L.replay_by_period(spark, df, start, "hour", str(tmp_path / "l"))
    assert sorted(cut.filter("status <> 'OPENING'").select(columns).collect(), key=lambda r: r[0]) == whole
    # A second run finds every period finished.
    again = L.replay_by_period(spark, df, start, "hour", str(tmp_path / "l"))
    assert sorted(again.filter("status <> 'OPENING'").select(columns).collect(), key=lambda r: r[0]) == whole
    # State handed over by hand.
    first, rest = df.filter("trade_id < 150"), df.filter("trade_id >= 150")
    a = L.replay_trades(first, start)
    b = L.replay_trades(rest, L.balances(a), L.open_positions(a))
    got = a.unionByName(b).filter("status <> 'OPENING'").select(columns).collect()
    assert sorted(got, key=lambda r: r[0]) == whole


def _plain(rows, balances, positions=()):
    """Trades folded one after the other."""
    books, out = {}, {}
    for u, b in balances.items():
        books[u] = L._Book(u)
        books[u].balance = b
    for u, s, q, p in positions:
        books[u].positions[s] = (q, p)
    for i, (u, s, side, q, p) in enumerate(rows):
        book = books.setdefault(u, L._Book(u))
        out[i] = (*book.apply(s, side, float(q), float(p)), book.balance, *book.positions.get(s, (0.0, 0.0)))
    return out


@pytest.mark.parametrize("balance", [300.0, 1e9])
def test_a_user_with_most_trades_lies_in_many_stretches(spark, monkeypatch, balance):
    """User 2 owns half of all trades and waits in several stretches; user 9 has no balance."""
    rnd = random.Random(3)
    sides = L.SIDES if balance < 1e6 else ["BUY", "SHORT"] * 6 + ["SELL", "COVER"]
    symbol = {"BUY": "ABC", "SELL": "ABC", "SHORT": "XY", "COVER": "XY"} if balance >= 1e6 else dict.fromkeys(L.SIDES, "AX")
    rows = []
    for _ in range(600):
        side = rnd.choice(sides)
        rows.append((rnd.choice([1, 2, 2, 2, 3, 9]), rnd.choice(symbol[side]), side, rnd.randint(1, 5), rnd.randint(1, 40) / 4))
    start, held = {1: balance, 2: balance, 3: balance}, [(2, "A", 7.0, 3.5), (2, "Z", -4.0, 2.0)]
    positions = spark.createDataFrame([(2, "A", "LONG", 7.0, 3.5), (2, "Z", "SHORT", 4.0, 2.0)],
                                      "user_id bigint, symbol string, side string, quantity double, avg_cost double")
    folds, fold = [], L._folded
    monkeypatch.setattr(L, "_folded", lambda df, open_only=False: folds.append(df) or fold(df, open_only))
    ledger = L.replay_trades(trades(spark, rows), users(spark, u1=balance, u2=balance, u3=balance), positions, stretches=6)
    stretches = ledger.filter("user_id = 2").groupBy(F.shiftright("seq", L._STRETCH_BITS).alias("s")).count().collect()
    assert len(stretches) >= 3 and max(r["count"] for r in stretches) < 200
    # Every stretch once, and again until the state at its border is known.
    assert len(folds) <= 1 + len(stretches)
    want, got = _plain(rows, start, held), ledger.filter("status <> 'OPENING'").collect()
    assert len(got) == len(rows) and ledger.filter("status = 'OPENING'").count() == 5
    for r in got:
        reason, entry, pnl, left, quantity, cost = want[r["trade_id"]]
        assert r["reject_reason"] == reason and r["position_after"] == quantity, r
        for found, value in ((r["entry_price"], entry), (r["realized_pnl"], pnl), (r["balance_after"], left), (r["avg_cost_after"], cost)):
            assert found == (None if value is None else pytest.approx(value, abs=1e-6))
    order = [r["trade_id"] for r in ledger.filter("user_id = 2 AND status <> 'OPENING'").orderBy("seq").collect()]
    assert order == sorted(order)


def test_one_sided(spark):
    rows = trades(spark, [(1, "A", "x", 1, 1)])
    assert L.one_sided(rows, "BUY").first()["side"] == "BUY"
    with pytest.raises(ValueError):
        L.one_sided(rows, "HOLD")


QUOTE = "symbol string, last_price double, bid double, ask double, current_price double, price double, previous_close double"


@pytest.mark.parametrize("quote, cost, want", [
    ((12.0, 1.0, 3.0, 9.0, 9.0, 8.0), 10.0, 12.0),
    ((None, 1.0, 3.0, 9.0, 9.0, 8.0), 10.0, 2.0),
    ((None, 0.0, 3.0, 9.0, 7.0, 8.0), 10.0, 9.0),
    ((None, None, None, None, 7.0, 8.0), 10.0, 7.0),
    ((None, None, None, None, None, 8.0), 10.0, 8.0),
    ((None, None, None, None, None, 0.0), 10.0, 10.0),
    ((0.0, 1.0, 3.0, 9.0, 9.0, 8.0), 10.0, 8.0),
    ((-5.0, None, None, None, None, None), 10.0, 10.0),
    ((6902.0, None, None, None, None, 447.0), 440.0, 447.0),
    ((6902.0, None, None, None, None, None), 440.0, 440.0),
    ((6902.0, None, None, None, None, 447.0), 2000.0, 6902.0),
])
def test_price_resolution(spark, quote, cost, want):
    held = spark.createDataFrame([(1, "A", "LONG", 2.0, cost)], "user_id bigint, symbol string, side string, quantity double, avg_cost double")
    quotes = spark.createDataFrame([("A", *quote)], QUOTE)
    row = P.position_metrics(P.with_quotes(held, quotes)).first()
    assert row["current_price"] == want
    assert row["unrealized_pnl"] == (want - cost) * 2 and row["market_value"] == want * 2


def test_missing_quote_and_totals(spark):
    held = spark.createDataFrame([(1, "A", "SHORT", 2.0, 10.0), (1, "B", "LONG", 0.0, 0.0)],
                                 "user_id bigint, symbol string, side string, quantity double, avg_cost double")
    quotes = spark.createDataFrame([("A", 8.0)], "symbol string, last_price double")
    metrics = P.position_metrics(P.with_quotes(held, quotes))
    by = {r["symbol"]: r for r in metrics.collect()}
    assert by["A"]["unrealized_pnl"] == 4 and by["A"]["return_percent"] == 20 and by["B"]["return_percent"] == 0
    totals = {r["user_id"]: r for r in P.portfolio_totals(users(spark, u1=100, u2=50), metrics).collect()}
    assert totals[1]["equity"] == 104 and totals[1]["net_liquidation"] == 124 and totals[2]["equity"] == 50


def test_snapshots(spark):
    snap = spark.createDataFrame([(1, dt.date(2024, 1, 1), 100.0), (1, dt.date(2024, 1, 3), 130.0), (2, dt.date(2024, 1, 2), 5.0)],
                                 "user_id bigint, date date, equity double")
    days = {(r["user_id"], r["date"].day): r["day_pnl"] for r in P.day_pnl(snap).collect()}
    assert days == {(1, 1): 0.0, (1, 3): 30.0, (2, 2): 0.0}
    new = spark.createDataFrame([(1, dt.date(2024, 1, 3), 131.0), (3, dt.date(2024, 1, 3), 1.0)], snap.schema)
    rows = {(r["user_id"], r["date"].day): r["equity"] for r in P.upsert_snapshots(snap, new).collect()}
    assert rows == {(1, 1): 100.0, (1, 3): 131.0, (2, 2): 5.0, (3, 3): 1.0}
    prev = {r["user_id"]: r["previous_equity"] for r in P.previous_equity(snap, F.lit("2024-01-03").cast("date")).collect()}
    assert prev == {1: 100.0, 2: 5.0}
    assert [r["equity"] for r in P.equity_history(snap, F.lit("2024-01-04").cast("date"), 2).collect()] == [130.0, 5.0]


def test_watchlist_toggles(spark):
    at = lambda i: T0 + dt.timedelta(minutes=i)
    ev = lambda n: spark.createDataFrame([(1, "TSLA", at(i)) for i in range(n)], "user_id bigint, symbol string, ts timestamp")
    assert [P.watchlist(ev(n)).count() for n in (1, 2, 3)] == [1, 0, 1]
    assert P.watchlist(ev(3)).first()["added_at"] == at(2)
    assert "password" not in P.drop_credentials(spark.createDataFrame([(1, "p")], "user_id int, password string")).columns
