"""Registered queries over trades, holdings and equity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.operators import asof
from tickerloom.operators import ledger as L
from tickerloom.operators import portfolio as P
from tickerloom.plans import views as V
from tickerloom.plans.registry import register
from tickerloom.session import shared_dir
from tickerloom.sources.candles import read_portfolio_table, write_portfolio_table

BALANCE = 2000.0


def _pick(prefix: str) -> str:
    return f"CASE t.symbol WHEN 'S0' THEN w.{prefix}0 WHEN 'S1' THEN w.{prefix}1 ELSE w.{prefix}2 END"


def _keep(prefix: str, new: str) -> str:
    return ", ".join(f"CASE WHEN ok AND symbol = 'S{i}' THEN {new} ELSE {prefix}{i} END AS {prefix}{i}"
                     for i in range(3))


_SIDES = """CASE event_type WHEN 'purchase' THEN 'BUY' WHEN 'view' THEN 'SELL'
              WHEN 'click' THEN 'SHORT' ELSE 'COVER' END"""


def _ledger_sql(side: str = _SIDES, held: tuple[float, float, float] = (0, 0, 0), cost: float = 0) -> str:
    """Trades walked one per step for every user at once; a short position has negative quantity."""
    return f"""
trades AS (
  SELECT user_id, event_id AS trade_id, ts, 'S' || (k % 3) AS symbol,
         {side} AS side,
         CAST(k % 10 + 1 AS DOUBLE) AS q, value AS p,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'signup')
),
walk AS (
  SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS trade_id, CAST({BALANCE} AS DOUBLE) AS bal,
         {', '.join(f'CAST({h} AS DOUBLE) AS h{i}' for i, h in enumerate(held))},
         {', '.join(f'CAST({cost if h else 0} AS DOUBLE) AS a{i}' for i, h in enumerate(held))},
         CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS DOUBLE) AS entry, CAST(NULL AS DOUBLE) AS pnl
  FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, n, trade_id,
         CASE WHEN NOT ok THEN bal WHEN side IN ('BUY', 'SHORT') THEN bal - q * p
              WHEN side = 'SELL' THEN bal + q * p ELSE bal + (q * a + (a - p) * q) END AS bal,
         {_keep('h', "CASE side WHEN 'BUY' THEN h + q WHEN 'SHORT' THEN h - q WHEN 'SELL' THEN h - q ELSE h + q END")},
         {_keep('a', "CASE WHEN side IN ('BUY', 'SHORT') THEN (abs(h) * a + q * p) / (abs(h) + q) "
                     "WHEN abs(h) = q THEN 0 ELSE a END")},
         reason,
         CASE WHEN ok AND side IN ('SELL', 'COVER') THEN a END AS entry,
         CASE WHEN ok AND side = 'SELL' THEN (p - a) * q WHEN ok AND side = 'COVER' THEN (a - p) * q END AS pnl
  FROM (
    SELECT *, reason IS NULL AS ok FROM (
      SELECT *, CASE
        WHEN q = 0 OR p = 0 THEN 'missing_field'
        WHEN side IN ('BUY', 'SHORT') AND bal < q * p THEN 'insufficient_funds'
        WHEN side = 'BUY' AND h < 0 OR side = 'SHORT' AND h > 0 THEN 'opposite_position'
        WHEN side = 'SELL' AND h <= 0 OR side = 'COVER' AND h >= 0 THEN 'no_position'
        WHEN side IN ('SELL', 'COVER') AND abs(h) < q THEN 'insufficient_quantity' END AS reason
      FROM (
        SELECT t.user_id, t.n, t.trade_id, t.symbol, t.side, t.q, t.p, w.bal, w.h0, w.h1, w.h2, w.a0, w.a1, w.a2,
               {_pick('h')} AS h, {_pick('a')} AS a
        FROM walk w JOIN trades t ON t.user_id = w.user_id AND t.n = w.n + 1
      )
    )
  )
)"""


LEDGER = _ledger_sql()


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    return L.replay_trades(V.trades(spark, sf), V.trade_users(spark, sf, BALANCE))


@register(f"""WITH RECURSIVE {LEDGER},
last AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1),
pos AS (
  SELECT user_id, 'S0' AS symbol, h0 AS h, a0 AS a FROM last
  UNION ALL SELECT user_id, 'S1', h1, a1 FROM last
  UNION ALL SELECT user_id, 'S2', h2, a2 FROM last
)
SELECT user_id, symbol, CASE WHEN h < 0 THEN 'SHORT' ELSE 'LONG' END AS side, abs(h) AS quantity,
       a AS avg_cost FROM pos WHERE h <> 0""")
def ledger_positions(spark: SparkSession, sf: str) -> DataFrame:
    return L.open_positions(_ledger(spark, sf))


_WALKED = """SELECT walk.user_id, walk.trade_id, symbol, side, q AS quantity, p AS price, q * p AS total_cost,
       CASE WHEN reason IS NULL THEN 'COMPLETED' ELSE 'REJECTED' END AS status, reason AS reject_reason,
       entry AS entry_price, pnl AS realized_pnl, bal AS balance_after
FROM walk JOIN trades ON walk.trade_id = trades.trade_id"""
_LEDGER_ROWS = f"WITH RECURSIVE {LEDGER} {_WALKED}"


def _ledger_rows(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("status") != "OPENING").select(
        "user_id", "trade_id", "symbol", "side", "quantity", "price", "total_cost", "status", "reject_reason",
        "entry_price", "realized_pnl", "balance_after")


@register(_LEDGER_ROWS)
def ledger_transactions(spark: SparkSession, sf: str) -> DataFrame:
    return _ledger_rows(_ledger(spark, sf))


@register(_LEDGER_ROWS)
def ledger_by_period(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows, replayed week by week from written state."""
    return _ledger_rows(L.replay_by_period(
        spark, V.trades(spark, sf), V.trade_users(spark, sf, BALANCE), unit="week"))


@register(f"WITH RECURSIVE {_ledger_sql(side=chr(39) + 'BUY' + chr(39))} {_WALKED}")
def buy_requests(spark: SparkSession, sf: str) -> DataFrame:
    """All requests as buys; those beyond the balance are rejected."""
    requests = V.trades(spark, sf).drop("side")
    return _ledger_rows(L.replay_trades(L.one_sided(requests, "BUY"), V.trade_users(spark, sf, BALANCE)))


#: Units of S0 and S1 that every user holds before the first sale, and their cost.
HELD, COST = (60.0, 25.0, 0.0), 12.5


@register(f"WITH RECURSIVE {_ledger_sql(side=chr(39) + 'SELL' + chr(39), held=HELD, cost=COST)} {_WALKED}")
def sell_requests(spark: SparkSession, sf: str) -> DataFrame:
    """All requests as sales out of given positions; those beyond them are rejected."""
    requests, users = V.trades(spark, sf).drop("side"), V.trade_users(spark, sf, BALANCE)
    held = F.explode(F.array(*[F.struct(F.lit(f"S{i}").alias("symbol"), F.lit(h).alias("quantity"))
                               for i, h in enumerate(HELD) if h]))
    positions = users.select("user_id", held.alias("h")).select(
        "user_id", "h.symbol", F.lit("LONG").alias("side"), "h.quantity", F.lit(COST).alias("avg_cost"))
    return _ledger_rows(L.replay_trades(L.one_sided(requests, "SELL"), users, positions))


@register(f"""WITH RECURSIVE {LEDGER}
SELECT walk.user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, round(sum(pnl), 6) AS realized_pnl,
       count(*) AS exits
FROM walk JOIN trades ON walk.trade_id = trades.trade_id WHERE pnl IS NOT NULL GROUP BY 1, 2""")
def realized_pnl_by_day(spark: SparkSession, sf: str) -> DataFrame:
    rows = L.realized_pnl_by_day(_ledger(spark, sf))
    return rows.select("user_id", F.date_format("date", "yyyy-MM-dd").alias("date"),
                       F.round("realized_pnl", 6).alias("realized_pnl"), "exits")


@register(f"""WITH RECURSIVE {LEDGER},
last AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1),
px AS (SELECT 'S' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 3) AS symbol,
              arg_max(value, row(ts, event_id)) AS price FROM events GROUP BY 1),
pos AS (
  SELECT user_id, 'S0' AS symbol, h0 AS h, a0 AS a FROM last
  UNION ALL SELECT user_id, 'S1', h1, a1 FROM last
  UNION ALL SELECT user_id, 'S2', h2, a2 FROM last
),
pnl AS (SELECT user_id, sum(CASE WHEN h < 0 THEN (a - price) * abs(h) ELSE (price - a) * h END) AS u,
               sum(abs(h) * a) AS basis
        FROM pos JOIN px USING (symbol) WHERE h <> 0 GROUP BY user_id)
SELECT user_id, bal AS balance, round(coalesce(u, 0), 6) AS unrealized_pnl,
       round(bal + coalesce(u, 0), 6) AS equity, round(bal + coalesce(basis, 0) + coalesce(u, 0), 6) AS net_liquidation
FROM last LEFT JOIN pnl USING (user_id)""")
def ledger_equity(spark: SparkSession, sf: str) -> DataFrame:
    ledger = _ledger(spark, sf)
    metrics = P.position_metrics(P.with_quotes(L.open_positions(ledger), V.trade_quotes(spark, sf)))
    totals = P.portfolio_totals(L.balances(ledger), metrics)
    money = ("unrealized_pnl", "equity", "net_liquidation")
    return totals.withColumns({c: F.round(c, 6) for c in money})


@register("""
WITH t AS (SELECT user_id, event_id AS trade_id, ts,
             CASE event_type WHEN 'purchase' THEN 'BUY' WHEN 'view' THEN 'SELL' WHEN 'click' THEN 'SHORT'
             ELSE 'COVER' END AS side, value AS price
           FROM events WHERE event_type <> 'signup')
SELECT user_id, trade_id, side, price, n FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, trade_id DESC) AS n FROM t) WHERE n <= 10""")
def recent_transactions(spark: SparkSession, sf: str) -> DataFrame:
    rows = L.recent_transactions(V.trades(spark, sf), 10)
    return rows.select("user_id", "trade_id", "side", "price", F.col("n").cast("bigint").alias("n"))


@register("""
SELECT user_id, 'S' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 3) AS symbol, count(*) AS toggles,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS added_at
FROM events WHERE event_type = 'signup' GROUP BY 1, 2 HAVING count(*) % 2 = 1""")
def watchlist_state(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.watchlist(V.watch_events(spark, sf)).orderBy("user_id", F.desc("added_at"))
    return rows.withColumn("added_at", F.date_format("added_at", "yyyy-MM-dd HH:mm:ss"))


_WATCH = """
w AS (SELECT user_id, 'S' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 3) AS symbol
      FROM events WHERE event_type = 'signup' GROUP BY 1, 2 HAVING count(*) % 2 = 1),
p AS (SELECT DISTINCT user_id, 'S' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 3) AS symbol
      FROM events WHERE event_type <> 'signup')"""


@register(f"""WITH {_WATCH}
SELECT user_id, symbol, (user_id, symbol) IN (SELECT (user_id, symbol) FROM w) AS listed FROM p""")
def watchlist_membership(spark: SparkSession, sf: str) -> DataFrame:
    listed = P.watchlist(V.watch_events(spark, sf))
    pairs = V.trades(spark, sf).select("user_id", "symbol").distinct()
    yes = P.in_watchlist(pairs, listed).withColumn("listed", F.lit(True))
    return yes.unionByName(P.in_watchlist(pairs, listed, absent=True).withColumn("listed", F.lit(False)))


_ORDER = "row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"
HOLDINGS = f"""
q AS (SELECT p_brand AS symbol, arg_max(l_extendedprice / l_quantity, {_ORDER}) AS last_price,
             arg_min(l_extendedprice / l_quantity, {_ORDER}) AS previous_close
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
h AS (SELECT o_custkey AS user_id, p_brand AS symbol,
             CASE WHEN max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 THEN 'SHORT' ELSE 'LONG' END AS side,
             sum(l_quantity) AS quantity, round(sum(l_extendedprice), 2) / sum(l_quantity) AS avg_cost
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
m AS (SELECT *, CASE
        WHEN (CASE WHEN last_price > 0 THEN last_price ELSE coalesce(nullif(previous_close, 0), avg_cost) END) > 5000
             AND avg_cost < 1000 THEN coalesce(nullif(previous_close, 0), avg_cost)
        WHEN last_price > 0 THEN last_price ELSE coalesce(nullif(previous_close, 0), avg_cost) END AS cp
      FROM h LEFT JOIN q USING (symbol)),
x AS (SELECT *, CASE WHEN cp > 0 THEN cp ELSE avg_cost END AS price FROM m),
y AS (SELECT *, CASE side WHEN 'SHORT' THEN (avg_cost - price) * quantity ELSE (price - avg_cost) * quantity END AS pnl
      FROM x)"""


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return P.position_metrics(P.with_quotes(V.holdings(spark, sf), V.eod_quotes(spark, sf)))


@register(f"""WITH {HOLDINGS}
SELECT user_id, symbol, side, quantity, avg_cost, price AS current_price, quantity * price AS market_value,
       pnl AS unrealized_pnl, pnl / (quantity * avg_cost) * 100 AS return_percent FROM y""")
def price_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf)


@register(f"""WITH {HOLDINGS},
t AS (SELECT user_id, sum(pnl) AS u, sum(quantity * avg_cost) AS basis FROM y GROUP BY user_id),
s AS (SELECT o_custkey AS user_id, CAST(o_orderdate AS DATE) AS d, round(sum(o_totalprice), 2) AS equity
      FROM orders GROUP BY 1, 2),
prev AS (SELECT user_id, arg_max(equity, d) AS pe FROM s WHERE d < DATE '2000-01-01' GROUP BY 1)
SELECT c_custkey AS user_id, c_acctbal AS balance, round(c_acctbal + coalesce(u, 0), 4) AS equity,
       round(coalesce(u, 0), 4) AS unrealized_pnl, round(coalesce(c_acctbal + coalesce(u, 0) - pe, 0), 4) AS day_pnl,
       c_acctbal AS cash, round(c_acctbal + coalesce(basis, 0) + coalesce(u, 0), 4) AS net_liquidation
FROM customer LEFT JOIN t ON c_custkey = t.user_id LEFT JOIN prev ON c_custkey = prev.user_id""")
def portfolio_summary(spark: SparkSession, sf: str) -> DataFrame:
    totals = P.portfolio_totals(V.customer_users(spark, sf), _metrics(spark, sf))
    rows = P.portfolio_summary(totals, V.snapshots(spark, sf), F.lit("2000-01-01").cast("date"))
    return rows.withColumns({c: F.round(c, 4) for c in ("equity", "unrealized_pnl", "day_pnl", "net_liquidation")})


@register(f"""WITH {HOLDINGS}, {_WATCH},
hh AS (SELECT user_id, count(*) AS holdings, sum(quantity * price) AS mv FROM y GROUP BY 1),
tx AS (SELECT user_id, least(count(*), 10) AS n FROM events WHERE event_type <> 'signup' GROUP BY 1),
wl AS (SELECT user_id, count(*) AS n FROM w GROUP BY 1)
SELECT c_custkey AS user_id, c_acctbal AS balance, coalesce(holdings, 0) AS holdings,
       round(coalesce(mv, 0), 2) AS market_value, coalesce(tx.n, 0) AS recent_transactions,
       coalesce(wl.n, 0) AS watchlist
FROM customer LEFT JOIN hh ON c_custkey = hh.user_id LEFT JOIN tx ON c_custkey = tx.user_id
  LEFT JOIN wl ON c_custkey = wl.user_id""")
def portfolio_view(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.portfolio_view(
        V.customer_users(spark, sf), _metrics(spark, sf),
        L.recent_transactions(V.trades(spark, sf), 10), P.watchlist(V.watch_events(spark, sf)))
    return rows.withColumn("market_value", F.round("market_value", 2))


@register(f"""WITH {HOLDINGS}, {_WATCH},
t AS (SELECT user_id, event_id, ts, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
      FROM events WHERE event_type <> 'signup'),
tx AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS n FROM t)
SELECT user_id, 'holding' AS section, symbol, 0 AS n, CAST(quantity AS DOUBLE) AS quantity,
       quantity * price AS amount FROM y
UNION ALL SELECT user_id, 'transaction', 'S' || (k % 3), n, k % 10 + 1, (k % 10 + 1) * value FROM tx WHERE n <= 10
UNION ALL SELECT user_id, 'watchlist', symbol, 0, NULL, NULL FROM w""")
def portfolio_rows(spark: SparkSession, sf: str) -> DataFrame:
    return P.portfolio_rows(_metrics(spark, sf), L.recent_transactions(V.trades(spark, sf), 10),
                            P.watchlist(V.watch_events(spark, sf)))


@register(f"""WITH RECURSIVE {LEDGER}, {HOLDINGS}, {_WATCH}
SELECT 'users' AS name, c_custkey AS user_id, 1 AS n, 100000.0::DOUBLE AS total FROM customer
UNION ALL SELECT 'holdings', user_id, count(*), round(sum(quantity), 2) FROM y GROUP BY user_id
UNION ALL SELECT 'transactions', walk.user_id, count(*), round(sum(q * p), 2)
  FROM walk JOIN trades ON walk.trade_id = trades.trade_id WHERE reason IS NULL GROUP BY walk.user_id
UNION ALL SELECT 'watchlist', user_id, count(*), 0 FROM w GROUP BY user_id
UNION ALL SELECT 'snapshots', user_id, count(*), round(sum(equity), 2) FROM (
  SELECT o_custkey AS user_id, round(sum(o_totalprice), 2) AS equity FROM orders GROUP BY 1, CAST(o_orderdate AS DATE))
  GROUP BY user_id""")
def portfolio_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The five portfolio tables written with their schemas and read back, counted and summed for each user."""
    ledger = L.replay_trades(V.trades(spark, sf), V.trade_users(spark, sf, BALANCE))
    made = {
        "users": (V.customer_users(spark, sf), F.col("initial_capital")),
        "holdings": (V.holdings(spark, sf), F.col("quantity")),
        "transactions": (L.transactions(ledger), F.col("total_cost")),
        "watchlist": (P.watchlist(V.watch_events(spark, sf)), F.lit(0.0)),
        "snapshots": (V.snapshots(spark, sf), F.col("equity")),
    }
    root, out = shared_dir(spark, "portfolio"), None
    for name, (rows, value) in made.items():
        write_portfolio_table(rows, f"{root}/{name}", name)
        back = read_portfolio_table(spark, f"{root}/{name}", name).groupBy("user_id").agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 2).alias("total"))
        part = back.select(F.lit(name).alias("name"), "user_id", "n", "total")
        out = part if out is None else out.unionByName(part)
    return out


SNAP = """s AS (SELECT o_custkey AS user_id, CAST(o_orderdate AS DATE) AS d, round(sum(o_totalprice), 2) AS equity
      FROM orders GROUP BY 1, 2)"""


@register(f"""WITH {SNAP}
SELECT user_id, CAST(d AS VARCHAR) AS date, equity,
       round(coalesce(equity - lag(equity) OVER (PARTITION BY user_id ORDER BY d), 0), 2) AS day_pnl FROM s""")
def day_pnl(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.day_pnl(V.snapshots(spark, sf))
    return rows.withColumns({"date": F.date_format("date", "yyyy-MM-dd"), "day_pnl": F.round("day_pnl", 2)})


# Every customer is asked about as of the days its line items were shipped.
_ASKED = """r AS (SELECT o_custkey AS user_id, l_orderkey, l_linenumber, l_partkey, l_suppkey,
             CAST(l_shipdate AS DATE) AS asked
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@register(f"""WITH {SNAP}, {_ASKED}
SELECT r.user_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(asked AS VARCHAR) AS as_of,
       CAST(s.d AS VARCHAR) AS date, s.equity
FROM r ASOF LEFT JOIN s ON r.user_id = s.user_id AND r.asked > s.d""")
def previous_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """The snapshot before each of many as-of days."""
    orders = V.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    items = V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("as_of"))
    asked = items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).drop("o_orderkey")
    rows = asof.as_of_join(asked, V.snapshots(spark, sf), ["user_id"], "as_of", "date", ["equity"], strict=True)
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("as_of", "date")})


@register(f"""WITH {SNAP}
SELECT user_id, CAST(d AS VARCHAR) AS date, equity FROM s
WHERE d BETWEEN DATE '2000-01-01' - 30 AND DATE '2000-01-01'""")
def equity_history(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.equity_history(V.snapshots(spark, sf), F.lit("2000-01-01").cast("date"))
    return rows.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@register(f"""WITH {SNAP},
n AS (SELECT c_custkey AS user_id, DATE '2000-01-01' AS d, c_acctbal AS equity FROM customer)
SELECT user_id, CAST(d AS VARCHAR) AS date, equity FROM n
UNION ALL
SELECT user_id, CAST(d AS VARCHAR), equity FROM s WHERE d <> DATE '2000-01-01'
   OR user_id NOT IN (SELECT user_id FROM n)""")
def snapshot_upsert(spark: SparkSession, sf: str) -> DataFrame:
    new = V.customer_users(spark, sf).select(
        "user_id", F.lit("2000-01-01").cast("date").alias("date"), F.col("balance").alias("equity"))
    rows = P.upsert_snapshots(V.snapshots(spark, sf), new)
    return rows.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@register(f"""WITH {HOLDINGS}, t AS (SELECT user_id, sum(pnl) AS u FROM y GROUP BY user_id)
SELECT c_custkey AS user_id, '2000-01-01' AS date, round(c_acctbal + coalesce(u, 0), 4) AS equity,
       c_acctbal AS balance, round(coalesce(u, 0), 4) AS unrealized_pnl, CAST(0 AS DOUBLE) AS realized_pnl
FROM customer LEFT JOIN t ON c_custkey = t.user_id""")
def daily_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    totals = P.portfolio_totals(V.customer_users(spark, sf), _metrics(spark, sf))
    rows = P.daily_snapshot(totals, F.lit("2000-01-01").cast("date"))
    return rows.withColumns({
        "date": F.date_format("date", "yyyy-MM-dd"), "equity": F.round("equity", 4),
        "unrealized_pnl": F.round("unrealized_pnl", 4)})


@register("""
SELECT event_id AS trade_id, CASE
    WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 = 0 OR value = 0 THEN 'missing_field'
    WHEN event_type NOT IN ('purchase', 'view', 'click', 'error') THEN 'invalid_side' END AS reject_reason
FROM events""")
def trade_request_check(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    names = {"purchase": "BUY", "view": "SELL", "click": "SHORT", "error": "COVER", "signup": "HOLD"}
    side = F.col("event_type")
    for kind, name in names.items():
        side = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(side)
    requests = V.table(spark, sf, "events").select(
        F.col("event_id").alias("trade_id"), F.col("event_type").alias("symbol"), side.alias("side"),
        (k % 10).cast("double").alias("quantity"), F.col("value").alias("price"))
    return L.check_requests(requests).select("trade_id", "reject_reason")


@register("SELECT c_custkey AS user_id, c_name AS name, c_acctbal AS balance FROM customer")
def user_profiles(spark: SparkSession, sf: str) -> DataFrame:
    users = V.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"),
        F.sha2("c_name", 256).alias("password_hash"))
    return P.drop_credentials(users)


@register("""WITH p AS (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 + 1 AS q, value
              FROM events WHERE value > 0)
SELECT user_id, count(*) AS buys, round(sum(q * value), 4) AS spent FROM p GROUP BY user_id""")
def one_sided_trades(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a buy request of a user with enough cash."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    requests = V.table(spark, sf, "events").select(
        "user_id", F.col("event_id").alias("trade_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("S"), k % 3).alias("symbol"), (k % 10 + 1).cast("double").alias("quantity"),
        F.col("value").alias("price"))
    ledger = L.replay_trades(L.one_sided(requests, "BUY"), V.trade_users(spark, sf, 1e12))
    return L.transactions(ledger).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("buys"), F.round(F.sum("total_cost"), 4).alias("spent"))
