"""Trade replay: balances, positions and accepted or rejected trades per user.

Each decision depends on the balance left by all earlier trades of the same user, and yet no
task reads a whole user.  Rows are dealt by range of (user, time), so a user with many trades
lies in many stretches, one for each task.  A user whose opening row is in a stretch is
folded there.  The one user at most who comes into a stretch from the one before is folded
from a guess of the balance and the positions at its border: all trades of the stretches
before accepted.  The folded stretches tell by how much each changed the state; sums over
the stretches before give the next guess, and stretches whose guess changed are folded again.
When nothing changes, every stretch starts from what the one before left.  A user in k
stretches takes at most k rounds; as long as few trades are rejected, two or three.

``replay_by_period`` also cuts the time axis by calendar, with the state between periods a
written table, so that a ledger can go on from there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickerloom.plans.stored import stored
from tickerloom.session import shared_dir

# Trade sides.
SIDES = ["BUY", "SELL", "SHORT", "COVER"]

LEDGER_SCHEMA = (
    "user_id bigint, trade_id bigint, ts timestamp, symbol string, side string, quantity double, "
    "price double, total_cost double, status string, reject_reason string, entry_price double, "
    "realized_pnl double, balance_after double, position_after double, avg_cost_after double, seq bigint"
)
# A user's opening balance and positions travel as rows that sort before trades; so does the
# state at the border of a stretch, which gives no rows of the ledger.
_BORDER_BALANCE, _BORDER_POSITION, _BALANCE, _POSITION, _TRADE = -2, -1, 0, 1, 2
_ORDER = ("user_id", "kind", "ts", "trade_id", "symbol")
#: Rows of a user are in the order of ``seq``: the stretch, then the place in it.
_STRETCH_BITS = 40
#: Guesses of one border that differ by less are one: sums in another order.
TOLERANCE = 1e-9


def check_requests(trades: DataFrame) -> DataFrame:
    """Add ``reject_reason``: a required field is absent or zero, the side is unknown, or the time is."""
    no_text = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    no_number = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)) == 0
    missing = no_text("symbol") | no_text("side") | no_number("quantity") | no_number("price")
    reason = F.when(missing, "missing_field").when(~F.col("side").isin(SIDES), "invalid_side")
    if "ts" in trades.columns:
        reason = reason.when(F.col("ts").isNull(), "missing_time")
    return trades.withColumn("reject_reason", reason)


def position_pnl(side: Column, avg_cost: Column, price: Column, quantity: Column) -> Column:
    """Profit of a position at ``price``; anything but SHORT counts as long."""
    return F.when(side == "SHORT", (avg_cost - price) * quantity).otherwise((price - avg_cost) * quantity)


def average_price(q0, a0, q1, p1):
    total = q0 + q1
    return (q0 * a0 + q1 * p1) / total if total else 0.0


class _Book:
    """One user's balance and positions; a short position has negative quantity."""

    def __init__(self, user_id: int):
        self.user_id, self.balance, self.positions, self.seq = user_id, None, {}, 0

    def apply(self, symbol: str, side: str, qty: float, price: float):
        """Returns (reject_reason, entry_price, realized_pnl)."""
        if self.balance is None:
            return "user_not_found", None, None
        value = qty * price
        held, avg = self.positions.get(symbol, (0.0, 0.0))
        if side in ("BUY", "SHORT"):
            sign = 1.0 if side == "BUY" else -1.0
            if self.balance < value:
                return "insufficient_funds", None, None
            if held * sign < 0:
                return "opposite_position", None, None
            self.positions[symbol] = (held + sign * qty, average_price(abs(held), avg, qty, price))
            self.balance -= value
            return None, None, None
        sign = 1.0 if side == "SELL" else -1.0
        if held * sign <= 0:
            return "no_position", None, None
        if abs(held) < qty:
            return "insufficient_quantity", None, None
        pnl = (price - avg) * qty if side == "SELL" else (avg - price) * qty
        self.balance += value if side == "SELL" else qty * avg + pnl
        left = held - sign * qty
        if left:
            self.positions[symbol] = (left, avg)
        else:
            del self.positions[symbol]
        return None, avg, pnl


_NAMES = [c.split()[0] for c in LEDGER_SCHEMA.split(", ")]
_FOLDED = LEDGER_SCHEMA + ", kind int, stretch int"


def _fold(batches: Iterator[pd.DataFrame], open_only: bool) -> Iterator[pd.DataFrame]:
    """Ledger rows of rows sorted by user and order; ``open_only`` puts off the first user unless its opening row is there."""
    book, stretch_of, waiting = None, None, False
    for batch in batches:
        out = []
        columns = ("user_id", "stretch", "kind", "trade_name", "ts", "symbol", "side", "quantity", "price", "reject_reason")
        for user, stretch, kind, trade, ts, symbol, side, qty, price, early in zip(*(batch[c] for c in columns)):
            if book is None or book.user_id != user or stretch_of != stretch:
                waiting = open_only and book is None and kind != _BALANCE
                book, stretch_of = _Book(user), stretch
            reason = entry = pnl = cost = None
            status = "OPENING"
            if waiting:
                reason, status = early if isinstance(early, str) else None, "WAITING"
            elif kind in (_BALANCE, _BORDER_BALANCE):
                book.balance = price
            elif kind in (_POSITION, _BORDER_POSITION):
                book.positions[symbol] = (qty, price)
            else:
                if isinstance(early, str):
                    reason = early
                else:
                    reason, entry, pnl = book.apply(symbol, side, qty, price)
                cost = qty * price
                status = "REJECTED" if reason else "COMPLETED"
            if kind < _BALANCE:
                continue
            book.seq += 1
            held, avg = book.positions.get(symbol, (0.0, 0.0))
            out.append((user, int(trade) if isinstance(trade, str) else None, ts, symbol, side, qty, price, cost, status, reason,
                        entry, pnl, book.balance, held, avg, (stretch << _STRETCH_BITS) + book.seq, kind, stretch))
        frame = pd.DataFrame(out, columns=[*_NAMES, "kind", "stretch"])
        # Ids beyond 2**53 do not survive a column of floats.
        frame["trade_id"] = pd.array([row[1] for row in out], dtype="Int64")
        yield frame


def _folded(rows: DataFrame, open_only: bool = False) -> DataFrame:
    # Ids travel as text: pandas would read a column with nulls as floats.
    named = rows.withColumn("trade_name", F.col("trade_id").cast("string")).drop("trade_id")
    return named.mapInPandas(lambda batches: _fold(batches, open_only), _FOLDED)


def _opening_rows(trades: DataFrame, users: DataFrame, positions: DataFrame | None) -> DataFrame:
    columns = ["user_id", "kind", "trade_id", "ts", "symbol", "side", "quantity", "price", "reject_reason"]
    null = lambda t: F.lit(None).cast(t)
    opening = users.select(
        "user_id", F.lit(_BALANCE).alias("kind"), null("bigint").alias("trade_id"), null("timestamp").alias("ts"),
        null("string").alias("symbol"), null("string").alias("side"), null("double").alias("quantity"),
        F.col("balance").alias("price"), null("string").alias("reject_reason"),
    )
    rows = check_requests(trades).withColumn("kind", F.lit(_TRADE)).select(columns).unionByName(opening)
    if positions is not None:
        signed = F.when(F.col("side") == "SHORT", -F.col("quantity")).otherwise(F.col("quantity"))
        rows = rows.unionByName(positions.select(
            "user_id", F.lit(_POSITION).alias("kind"), null("bigint").alias("trade_id"),
            null("timestamp").alias("ts"), "symbol", "side", signed.alias("quantity"),
            F.col("avg_cost").alias("price"), null("string").alias("reject_reason"),
        ))
    return rows


def replay_trades(trades: DataFrame, users: DataFrame, positions: DataFrame | None = None,
                  stretches: int | None = None) -> DataFrame:
    """One ledger row per trade, plus one OPENING row per given balance and position.

    ``trades(user_id, trade_id, ts, symbol, side, quantity, price)``,
    ``users(user_id, balance)``, optional ``positions(user_id, symbol, side,
    quantity, avg_cost)`` held before the first trade.  ``stretches`` is the number of
    tasks that the rows are dealt to (default: shuffle partitions).  Trades of a user
    without a balance are rejected; rows of one time are taken by id, then symbol.
    """
    parts = stretches or int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _opening_rows(trades, users, positions)
    dealt = rows.repartitionByRange(parts, *_ORDER).sortWithinPartitions(*_ORDER).withColumn(
        "stretch", F.spark_partition_id())
    first = stored(_folded(dealt, open_only=True), "ledger")
    known, waiting = first.filter("status <> 'WAITING'"), first.filter("status = 'WAITING'")
    # At most one user waits in a stretch.
    borders = [(r.user_id, r.stretch) for r in waiting.select("user_id", "stretch").distinct().collect()]
    if not borders:
        return known.select(_NAMES)
    return known.select(_NAMES).unionByName(_fold_waiting(known, waiting, borders).select(_NAMES))


def _fold_waiting(known: DataFrame, waiting: DataFrame, borders: list[tuple[int, int]]) -> DataFrame:
    """Stretches folded from guessed states, again until each begins with what the one before leaves."""
    spark = known.sparkSession
    places = spark.createDataFrame(borders, "user_id bigint, stretch int")
    carried = known.join(F.broadcast(places.select("user_id").distinct()), "user_id", "left_semi")
    start = balances(carried), _held(carried, ["user_id", "symbol"])
    rows = waiting.select("user_id", "kind", "trade_id", "ts", "symbol", "side", "quantity", "price", "reject_reason", "stretch")

    def fold(pieces: DataFrame) -> DataFrame:
        return _folded(pieces.repartition(len(borders), "user_id", "stretch").sortWithinPartitions(
            "user_id", "stretch", *_ORDER[1:]))

    if len({user for user, _ in borders}) == len(borders):
        # Nothing lies between these stretches and the known state.
        return fold(rows.unionByName(_as_rows(places.join(start[0], "user_id"), "balance").unionByName(
            _as_rows(places.join(start[1].filter("held <> 0"), "user_id"), "avg_cost", "held"))))
    results: list[tuple[DataFrame, set[tuple[int, int]]]] = []
    state, changed = None, set(borders)
    while changed:
        guess = _first_guess(places, start, _if_all_accepted(rows)) if state is None else _next_guess(
            places, start, state, _latest(results, places.schema))
        if state is not None:
            changed = {(r.user_id, r.stretch) for r in _differing(state, guess).collect()}
            if not changed:
                break
        state = stored(guess, "ledger_borders")
        again = F.broadcast(spark.createDataFrame(sorted(changed), places.schema))
        done = stored(fold(rows.unionByName(state).join(again, ["user_id", "stretch"], "left_semi").select(*rows.columns)),
                      "ledger")
        results = [(table, kept - changed) for table, kept in results] + [(done, changed)]
    return _latest(results, places.schema)


def _as_rows(states: DataFrame, price: str, held: str | None = None) -> DataFrame:
    """Balances, or positions with their signed quantity, as rows before the trades of a stretch."""
    null = lambda t: F.lit(None).cast(t)
    return states.select(
        "user_id", F.lit(_BORDER_POSITION if held else _BORDER_BALANCE).alias("kind"), null("bigint").alias("trade_id"),
        null("timestamp").alias("ts"), F.col("symbol") if held else null("string").alias("symbol"),
        null("string").alias("side"), F.col(held) if held else null("double").alias("quantity"), F.col(price).alias("price"),
        null("string").alias("reject_reason"), "stretch").withColumnsRenamed({held: "quantity"} if held else {})


def _latest(results: list[tuple[DataFrame, set[tuple[int, int]]]], schema: StructType) -> DataFrame:
    """Of each stretch the rows of its last round."""
    out = None
    for table, kept in results:
        if kept:
            of = F.broadcast(table.sparkSession.createDataFrame(sorted(kept), schema))
            part = table.join(of, ["user_id", "stretch"], "left_semi")
            out = part if out is None else out.unionByName(part)
    return out


def _held(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Signed quantity and average cost after the last accepted row of each key."""
    return ledger.filter((F.col("status") != "REJECTED") & F.col("symbol").isNotNull()).groupBy(*keys).agg(
        F.max_by("position_after", "seq").alias("held"), F.max_by("avg_cost_after", "seq").alias("avg_cost"))


def _if_all_accepted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each stretch does to balance and positions if every well-formed trade is accepted."""
    good = rows.filter(F.col("reject_reason").isNull())
    value, entry = F.col("quantity") * F.col("price"), F.col("side").isin("BUY", "SHORT")
    trade = F.col("kind") == _TRADE
    cash = good.groupBy("user_id", "stretch").agg(
        F.sum(F.when(trade & entry, -value).when(trade, value)).alias("change"))
    signed = F.when(~trade | F.col("side").isin("BUY", "COVER"), F.col("quantity")).otherwise(-F.col("quantity"))
    opened = ~trade | entry
    bought = F.sum(F.when(opened, F.abs("quantity")))
    held = good.filter(F.col("symbol").isNotNull()).groupBy("user_id", "stretch", "symbol").agg(
        F.sum(signed).alias("change"), (F.sum(F.when(opened, F.abs(value))) / F.nullif(bought, F.lit(0.0))).alias("avg_cost"))
    return cash, held


def _first_guess(places: DataFrame, start: tuple[DataFrame, DataFrame], changes: tuple[DataFrame, DataFrame]) -> DataFrame:
    """State before each stretch as rows: the user's known state and the changes of the stretches before."""
    before = Window.partitionBy("user_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    cash = places.join(start[0], "user_id").join(changes[0], ["user_id", "stretch"], "left").select(
        "user_id", "stretch", (F.col("balance") + F.coalesce(F.sum("change").over(before), F.lit(0.0))).alias("balance"))
    by = Window.partitionBy("user_id", "symbol").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    held = _every_symbol(places, start[1], changes[1]).select(
        "user_id", "stretch", "symbol",
        (F.col("first_held") + F.coalesce(F.sum("change").over(by), F.lit(0.0))).alias("held"),
        F.coalesce(F.last("avg_cost", ignorenulls=True).over(by), "first_cost").alias("avg_cost"))
    return _as_rows(cash, "balance").unionByName(_as_rows(held.filter("held <> 0"), "avg_cost", "held"))


def _every_symbol(places: DataFrame, start: DataFrame, of_stretch: DataFrame) -> DataFrame:
    """A row for each stretch and symbol of its user, with what is known at first and of the stretch."""
    symbols = start.select("user_id", "symbol").union(of_stretch.select("user_id", "symbol")).distinct()
    first = start.select("user_id", "symbol", F.col("held").alias("first_held"), F.col("avg_cost").alias("first_cost"))
    rows = places.join(symbols, "user_id").join(of_stretch, ["user_id", "stretch", "symbol"], "left").join(
        first, ["user_id", "symbol"], "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("first_held", "first_cost")})


def _next_guess(places: DataFrame, start: tuple[DataFrame, DataFrame], state: DataFrame, ledger: DataFrame) -> DataFrame:
    """State before each stretch: what the stretch before left, moved by all differences at the borders before that.

    Where no border before differs, this is exactly what the stretch before left.
    """
    def moved(left: Column, entered: Column, by: WindowSpec) -> tuple[Column, Column]:
        return left, F.coalesce(F.sum(left - entered).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))

    user, symbol = (Window.partitionBy(*k).orderBy("stretch") for k in (["user_id"], ["user_id", "symbol"]))
    entered = state.filter(F.col("kind") == _BORDER_BALANCE).select("user_id", "stretch", F.col("price").alias("before"))
    after = ledger.groupBy("user_id", "stretch").agg(F.max_by("balance_after", "seq").alias("after"))
    cash = places.join(start[0], "user_id").join(entered, ["user_id", "stretch"]).join(after, ["user_id", "stretch"]).withColumn(
        "left", F.coalesce(F.lag("after").over(user), "balance"))
    value, shift = moved(F.col("left"), F.col("before"), user)
    cash = cash.select("user_id", "stretch", (value + shift).alias("balance"))

    had = state.filter(F.col("kind") == _BORDER_POSITION).select(
        "user_id", "stretch", "symbol", F.col("quantity").alias("before"))
    touched = _held(ledger, ["user_id", "stretch", "symbol"]).withColumn("avg_cost", F.when(F.col("held") != 0, F.col("avg_cost")))
    of_stretch = had.join(touched, ["user_id", "stretch", "symbol"], "full")
    every = _every_symbol(places, start[1], of_stretch).withColumn("before", F.coalesce("before", F.lit(0.0))).withColumn(
        "left", F.coalesce(F.lag(F.coalesce("held", "before")).over(symbol), "first_held"))
    value, shift = moved(F.col("left"), F.col("before"), symbol)
    cost = F.last("avg_cost", ignorenulls=True).over(symbol.rowsBetween(Window.unboundedPreceding, -1))
    held = every.select("user_id", "stretch", "symbol", (value + shift).alias("held"),
                        F.coalesce(cost, "first_cost").alias("avg_cost")).filter("held <> 0")
    return _as_rows(cash, "balance").unionByName(_as_rows(held, "avg_cost", "held"))


def _differing(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stretches whose state differs by more than the order of sums explains."""
    keys = ["user_id", "stretch", "kind", "symbol"]
    a = old.select(*keys, F.col("quantity").alias("q0"), F.col("price").alias("p0"), F.lit(True).alias("was"))
    b = new.select(*keys, F.col("quantity").alias("q1"), F.col("price").alias("p1"), F.lit(True).alias("now"))
    same = lambda x, y: F.abs(x - y) <= TOLERANCE * F.greatest(F.lit(1.0), F.abs(x), F.abs(y))
    tests = [a[k].eqNullSafe(b[k]) for k in keys]
    both = a.join(b, tests[0] & tests[1] & tests[2] & tests[3], "full").select(
        F.coalesce(a["user_id"], b["user_id"]).alias("user_id"), F.coalesce(a["stretch"], b["stretch"]).alias("stretch"),
        (F.col("was") & F.col("now") & same(F.col("p0"), F.col("p1"))
         & (a["symbol"].isNull() | same(F.col("q0"), F.col("q1")))).alias("same"))
    return both.filter(~F.coalesce("same", F.lit(False))).select("user_id", "stretch").distinct()


def one_sided(requests: DataFrame, side: str) -> DataFrame:
    """Buy-only or sell-only requests as trades."""
    if side not in SIDES:
        raise ValueError(f"unknown side: {side}")
    return requests.withColumn("side", F.lit(side))


def transactions(ledger: DataFrame) -> DataFrame:
    """Completed trades; entry price and realized profit only on exits."""
    return ledger.filter(F.col("status") == "COMPLETED").select(
        "user_id", "trade_id", "ts", "symbol", F.col("side").alias("type"), "quantity", "price", "total_cost",
        "entry_price", "realized_pnl", "status",
    )


def _order(ledger: DataFrame) -> Column:
    """The order of a user's rows; numbers start again in each period."""
    return F.struct("period", "seq") if "period" in ledger.columns else F.struct("seq")


def open_positions(ledger: DataFrame) -> DataFrame:
    """Positions left after the last accepted trade of each (user, symbol)."""
    at = _order(ledger)
    last = ledger.filter((F.col("status") != "REJECTED") & F.col("symbol").isNotNull()).groupBy(
        "user_id", "symbol"
    ).agg(F.max_by("position_after", at).alias("held"), F.max_by("avg_cost_after", at).alias("avg_cost"))
    return last.filter(F.col("held") != 0).select(
        "user_id", "symbol",
        F.when(F.col("held") < 0, "SHORT").otherwise("LONG").alias("side"),
        F.abs("held").alias("quantity"), "avg_cost",
    )


def balances(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("user_id").agg(F.max_by("balance_after", _order(ledger)).alias("balance")).filter(
        F.col("balance").isNotNull())


def realized_pnl_by_day(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("realized_pnl").isNotNull()).groupBy(
        "user_id", F.to_date("ts").alias("date")
    ).agg(F.sum("realized_pnl").alias("realized_pnl"), F.count(F.lit(1)).alias("exits"))


def recent_transactions(tx: DataFrame, limit: int = 50) -> DataFrame:
    """Latest ``limit`` rows per user, newest first; 0 means all."""
    if limit <= 0:
        return tx.orderBy("user_id", F.desc("ts"), F.desc("trade_id"))
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("trade_id"))
    return tx.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit)


def replay_by_period(spark: SparkSession, trades: DataFrame, users: DataFrame, unit: str = "week",
                     path: str | None = None) -> DataFrame:
    """Replay period by period, each from the written balances and positions of the one before.

    The number of rounds is the number of calendar periods in the data.  Give ``path`` to
    go on after a stop.  A period's folder is named by a signature of its trades, of all
    periods before and of the users, so that late trades and new users make a period and
    those after it run again, and nothing else.  Trades without a time come last, rejected.
    """
    path = path or shared_dir(spark, "ledger")
    period = F.coalesce(F.date_format(F.date_trunc(unit, "ts"), "yyyy-MM-dd-HH"), F.lit("without-time"))
    tagged = trades.withColumn("period", period)
    digest = lambda df: F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))
    periods = tagged.groupBy("period").agg(F.count("*").alias("n"), digest(trades).alias("h")).orderBy("period").collect()
    state_users, state_positions = users.select("user_id", "balance"), None
    first = state_users.agg(F.count("*").alias("n"), digest(state_users).alias("h")).first()
    chain = hashlib.blake2b(f"{first.n} {first.h}".encode(), digest_size=12)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    done = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS"))
    # One pass deals the trades out by period; each round reads its own folder.
    dealt = f"{shared_dir(spark, 'trades')}"
    tagged.write.partitionBy("period").parquet(dealt)
    source = spark.read.schema(tagged.schema).parquet(dealt)
    ledger = None
    for p in periods:
        chain.update(f"{p.period} {p.n} {p.h}".encode())
        part = f"{path}/{p.period}-{chain.hexdigest()}"
        if not done(f"{part}/rows"):
            rows = replay_trades(source.filter(F.col("period") == p.period).drop("period"), state_users, state_positions)
            rows.write.mode("overwrite").parquet(f"{part}/rows")
        rows = spark.read.schema(LEDGER_SCHEMA).parquet(f"{part}/rows")
        for name, make in (("users", balances), ("positions", open_positions)):
            if not done(f"{part}/{name}"):
                make(rows).write.mode("overwrite").parquet(f"{part}/{name}")
        state_users = spark.read.parquet(f"{part}/users")
        state_positions = spark.read.parquet(f"{part}/positions")
        own = rows.withColumn("period", F.lit(p.period))
        ledger = own if ledger is None else ledger.unionByName(own)
    if ledger is None:
        return replay_trades(trades, state_users).withColumn("period", F.lit(None).cast("string"))
    return ledger
