"""Portfolio metrics over holdings, quotes and equity snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.operators.ledger import position_pnl

# A price above the first is not believed while the average cost is below the second.
PRICE_CEILING = 5000
COST_FLOOR = 1000

# Quote fields the price chain may use; absent ones count as missing.
QUOTE_FIELDS = ["last_price", "bid", "ask", "current_price", "price", "previous_close"]


def with_quotes(holdings: DataFrame, quotes: DataFrame) -> DataFrame:
    """Holdings with their symbol's quote; a symbol without quote gets empty fields."""
    have = [c for c in QUOTE_FIELDS if c in quotes.columns]
    out = holdings.join(quotes.select("symbol", *have), "symbol", "left")
    return out.withColumns({c: F.lit(None).cast("double") for c in QUOTE_FIELDS if c not in have}) \
        if len(have) < len(QUOTE_FIELDS) else out


def resolve_price(avg_cost: str = "avg_cost") -> Column:
    """The price a holding is valued at.

    The first present field of the chain counts even when it is 0; a price that is
    not positive, or not believable, falls back to the previous close and then to
    the average cost.
    """
    cost = F.col(avg_cost)
    nonzero = lambda c: F.nullif(F.col(c), F.lit(0.0))
    prev = F.coalesce(nonzero("previous_close"), cost)
    mid = (nonzero("bid") + nonzero("ask")) / 2
    raw = F.coalesce(F.col("last_price"), mid, F.col("current_price"), F.col("price"), prev)
    price = F.when(raw > 0, raw).otherwise(prev)
    doubted = (price > PRICE_CEILING) & (F.coalesce(cost, F.lit(0.0)) < COST_FLOOR)
    price = F.when(doubted, F.coalesce(F.nullif(prev, F.lit(0.0)), cost)).otherwise(price)
    return F.when(price > 0, price).otherwise(cost)


def position_metrics(priced: DataFrame) -> DataFrame:
    """Market value, unrealized profit and percent return of holdings joined with quotes."""
    df = priced.withColumn("current_price", resolve_price())
    pnl = position_pnl(F.col("side"), F.col("avg_cost"), F.col("current_price"), F.col("quantity"))
    basis = F.col("quantity") * F.col("avg_cost")
    return df.select(
        "user_id", "symbol", "side", "quantity", "avg_cost", "current_price",
        (F.col("quantity") * F.col("current_price")).alias("market_value"),
        pnl.alias("unrealized_pnl"),
        F.when(basis > 0, pnl / basis * 100).otherwise(0.0).alias("return_percent"),
    )


def portfolio_totals(users: DataFrame, metrics: DataFrame) -> DataFrame:
    """Equity (balance plus unrealized profit) per user, and cash plus cost basis as net liquidation."""
    sums = metrics.groupBy("user_id").agg(
        F.sum("unrealized_pnl").alias("unrealized_pnl"),
        F.sum(F.col("quantity") * F.col("avg_cost")).alias("cost_basis"),
    )
    pnl, basis = F.coalesce("unrealized_pnl", F.lit(0.0)), F.coalesce("cost_basis", F.lit(0.0))
    balance = F.coalesce("balance", F.lit(0.0))
    return users.join(sums, "user_id", "left").select(
        "user_id", balance.alias("balance"), pnl.alias("unrealized_pnl"), (balance + pnl).alias("equity"),
        (balance + basis + pnl).alias("net_liquidation"),
    )


def previous_equity(snapshots: DataFrame, asof: Column) -> DataFrame:
    """Latest equity per user from a day before ``asof``."""
    return snapshots.filter(F.col("date") < asof).groupBy("user_id").agg(
        F.max_by("equity", "date").alias("previous_equity"), F.max("date").alias("previous_date"))


def portfolio_summary(totals: DataFrame, snapshots: DataFrame, asof: Column) -> DataFrame:
    """Balance, equity, unrealized and day profit, cash; without history the day profit is 0."""
    prev = previous_equity(snapshots, asof)
    return totals.join(prev, "user_id", "left").select(
        "user_id", "balance", "equity", "unrealized_pnl",
        F.coalesce(F.col("equity") - F.col("previous_equity"), F.lit(0.0)).alias("day_pnl"),
        F.col("balance").alias("cash"), "net_liquidation",
    )


def day_pnl(snapshots: DataFrame) -> DataFrame:
    """Equity change against the user's snapshot before, 0 for the first.

    Snapshots are unique per (user, day), so a window group is bounded by the
    calendar whatever the size of the table.
    """
    w = Window.partitionBy("user_id").orderBy("date")
    change = F.col("equity") - F.lag("equity").over(w)
    return snapshots.withColumn("day_pnl", F.coalesce(change, F.lit(0.0)))


def equity_history(snapshots: DataFrame, asof: Column, days: int = 30) -> DataFrame:
    return snapshots.filter(F.col("date").between(F.date_sub(asof, days), asof)).orderBy("user_id", "date")


def daily_snapshot(totals: DataFrame, asof: Column) -> DataFrame:
    return totals.select(
        "user_id", asof.alias("date"), "equity", "balance", "unrealized_pnl", F.lit(0.0).alias("realized_pnl"))


def upsert_snapshots(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per (user, day); an incoming row replaces the stored one."""
    columns = current.columns
    values = F.struct(*[c for c in columns if c not in ("user_id", "date")])
    both = current.withColumn("_v", F.lit(0)).unionByName(incoming.select(columns).withColumn("_v", F.lit(1)))
    last = both.groupBy("user_id", "date").agg(F.max_by(values, "_v").alias("v"))
    return last.select("user_id", "date", "v.*").select(columns)


def watchlist(events: DataFrame) -> DataFrame:
    """Each event flips (user, symbol); an odd count means listed, since the last event."""
    return events.groupBy("user_id", "symbol").agg(
        F.count(F.lit(1)).alias("toggles"), F.max("ts").alias("added_at")
    ).filter(F.col("toggles") % 2 == 1)


def in_watchlist(pairs: DataFrame, listed: DataFrame, absent: bool = False) -> DataFrame:
    return pairs.join(listed, ["user_id", "symbol"], "left_anti" if absent else "left_semi")


def portfolio_view(users: DataFrame, metrics: DataFrame, recent: DataFrame, listed: DataFrame) -> DataFrame:
    """Counts and totals of each user's holdings, recent transactions and watchlist.

    The parts stay tables of their own; gathering them into one nested row per user
    would put an unbounded group into a single value.
    """
    held = metrics.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("holdings"), F.sum("market_value").alias("market_value"))
    done = recent.groupBy("user_id").agg(F.count(F.lit(1)).alias("recent_transactions"))
    seen = listed.groupBy("user_id").agg(F.count(F.lit(1)).alias("watchlist"))
    out = users
    for part in (held, done, seen):
        out = out.join(part, "user_id", "left")
    return out.fillna(0, ["holdings", "recent_transactions", "watchlist"]).fillna(0.0, ["market_value"])


def portfolio_rows(metrics: DataFrame, recent: DataFrame, listed: DataFrame) -> DataFrame:
    """The parts of every user's portfolio view as rows: holdings, recent transactions in order, watchlist.

    ``n`` is the place of a transaction (1 is the newest), 0 elsewhere; a user's view is the rows of
    that user, without any value that grows with them.
    """
    none = F.lit(None).cast("double")
    row = lambda section, n, quantity, amount: [
        "user_id", F.lit(section).alias("section"), "symbol", n.cast("int").alias("n"), quantity.alias("quantity"),
        amount.alias("amount")]
    held = metrics.select(row("holding", F.lit(0), F.col("quantity").cast("double"), F.col("market_value")))
    done = recent.select(row("transaction", F.col("n"), F.col("quantity"), F.col("quantity") * F.col("price")))
    return held.unionByName(done).unionByName(listed.select(row("watchlist", F.lit(0), none, none)))


def drop_credentials(users: DataFrame) -> DataFrame:
    return users.drop("password", "password_hash")
