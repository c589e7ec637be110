"""Registered streaming queries.  Each must give what its batch form gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickerloom.plans import views as V
from tickerloom.plans.news_queries import (
    _BUCKETS, NEWS, SIGNAL, TITLE_KEY, _signal_articles,
)
from tickerloom.plans.portfolio_queries import BALANCE, LEDGER
from tickerloom.plans.registry import register
from tickerloom.plans.stored import stored
from tickerloom.session import shared_dir
from tickerloom.streaming import live

SLICES = 3


def _replay(df: DataFrame, order: str, name: str, build: Callable[[DataFrame], DataFrame], path: str,
            mode: str = "update", late_hours: int = 0, sink: Callable | None = None, last: DataFrame | None = None) -> StructType:
    """Run the stream ``build`` over ``df`` arriving in slices of ``order``; returns its schema.

    Each slice is written by as many tasks as its scan has, then the query goes on from its
    checkpoint until nothing is left.  A row arrives up to ``late_hours`` hours late.  ``last``
    holds rows that come after all others.
    """
    spark = df.sparkSession
    source = shared_dir(spark, name)
    at = F.col(order).cast("timestamp")
    if late_hours:
        at += F.make_interval(hours=F.pmod(F.xxhash64(*df.columns), F.lit(late_hours + 1)).cast("int"))
    # Bounds and slices read the rows as one pass has written them.
    columns = df.columns
    df = stored(df.withColumn("_at", at), f"{name}-timed")
    bounds = df.agg(F.percentile_approx("_at", [i / SLICES for i in range(1, SLICES)])).first()[0] or []
    place = sum((F.when(F.col("_at") > F.lit(b), 1).otherwise(0) for b in bounds), F.lit(0))
    rows = df.select(columns)
    slices = [df.filter(place == i).select(columns) for i in range(SLICES)]
    for arrived in [*slices, last] if last is not None else slices:
        arrived.write.mode("append").parquet(source)
        stream = build(spark.readStream.schema(rows.schema).parquet(source))
        live.run_available(stream, path, mode, sink)
    return stream.schema


@register("""
SELECT event_type AS symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, arg_min(value, row(ts, event_id)) AS open,
       max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close,
       CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS volume
FROM events GROUP BY 1, 2""")
def stream_bars(spark: SparkSession, sf: str) -> DataFrame:
    ticks = V.event_ticks(spark, sf).select(
        "symbol", F.col("ts").cast("timestamp").alias("ts"), "price", "volume", F.col("event_id").alias("seq"))
    path = shared_dir(spark, "stream-bars")
    schema = _replay(ticks, "ts", "ticks", live.stream_bars, path, late_hours=12)
    rows = live.read_latest(spark, f"{path}/log", ["symbol", "start"], schema)
    return rows.select("symbol", F.date_format("start", "yyyy-MM-dd").alias("date"),
                       "open", "high", "low", "close", "volume")


@register(f"""WITH RECURSIVE {LEDGER}
SELECT walk.user_id, walk.trade_id, CASE WHEN reason IS NULL THEN 'COMPLETED' ELSE 'REJECTED' END AS status,
       reason AS reject_reason, pnl AS realized_pnl, bal AS balance_after
FROM walk JOIN trades ON walk.trade_id = trades.trade_id""")
def stream_ledger(spark: SparkSession, sf: str) -> DataFrame:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STATE_STORE)
    path = shared_dir(spark, "stream-ledger")
    trades = V.trades(spark, sf)
    # A row of nobody, a week after all trades, lets the watermark pass the last of them.
    close = trades.agg((F.max("ts") + F.expr("INTERVAL 7 DAYS")).alias("ts")).select(
        *[F.col(c) if c == "ts" else (F.lit(-1) if c == "user_id" else F.lit(None)).cast(trades.schema[c].dataType).alias(c)
          for c in trades.columns])
    schema = _replay(trades, "ts", "trades", lambda rows: live.stream_ledger(rows, BALANCE, "2 days"), path, "append",
                     late_hours=24, last=close)
    rows = spark.read.schema(schema).parquet(f"{path}/table").filter("user_id >= 0")
    return rows.select("user_id", "trade_id", "status", "reject_reason", "realized_pnl", "balance_after")


@register(f"WITH {NEWS} SELECT DISTINCT {TITLE_KEY} AS title_key FROM news")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The given articles span thirty days, so a watermark of sixty keeps every key."""
    rows = V.news(spark, sf).select("id", "title", F.col("published").cast("timestamp").alias("published"))
    path = shared_dir(spark, "stream-dedup")
    schema = _replay(rows, "published", "articles", lambda articles: live.stream_dedup(articles, late="60 days"), path,
                     "append", late_hours=24)
    return spark.read.schema(schema).parquet(f"{path}/table").select("title_key")


@register("""
SELECT user_id, 'S' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 3) AS symbol, count(*) AS toggles,
       count(*) % 2 = 1 AS listed FROM events WHERE event_type = 'signup' GROUP BY 1, 2""")
def stream_watchlist(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "stream-watchlist")
    schema = _replay(V.watch_events(spark, sf), "ts", "toggles", live.stream_watchlist, path, late_hours=24)
    rows = live.read_latest(spark, f"{path}/log", ["user_id", "symbol"], schema)
    return rows.select("user_id", "symbol", "toggles", "listed")


@register(f"""WITH {NEWS}, {SIGNAL}
SELECT ticker, CAST(date AS VARCHAR) AS date, count(*) AS total_signals,
       round(avg(polarity), 10) AS avg_sentiment_polarity, round(avg(semantic), 10) AS avg_semantic_impact, {_BUCKETS}
FROM art GROUP BY 1, 2""")
def stream_daily_signals(spark: SparkSession, sf: str) -> DataFrame:
    articles = _signal_articles(spark, sf).withColumn("published", F.col("date").cast("timestamp")).drop("date")
    path = shared_dir(spark, "stream-signals")
    schema = _replay(articles, "published", "scored", live.stream_daily_signals, path, late_hours=24)
    out = live.read_latest(spark, f"{path}/log", ["ticker", "date"], schema)
    means = ("avg_sentiment_polarity", "avg_semantic_impact")
    return out.withColumns({"date": F.date_format("date", "yyyy-MM-dd"), **{c: F.round(c, 10) for c in means}})


@register("""
SELECT o_custkey AS user_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, max(o_totalprice) AS equity
FROM orders GROUP BY 1, 2""")
def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Running day maxima arrive as updates; the last update of each (user, day) stays."""
    orders = V.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("date").alias("date"), "o_totalprice",
        F.timestamp_seconds(F.col("o_orderkey")).alias("arrived"))
    path = shared_dir(spark, "stream-upsert")
    store = live.KeyedStore(spark, f"{path}/table", ["user_id", "date"], "user_id bigint, date date, equity double",
                            F.date_format("date", "yyyy-MM"))
    _replay(orders, "arrived", "orders", lambda rows: rows.groupBy("user_id", "date").agg(
        F.max("o_totalprice").alias("equity")), path, late_hours=24, sink=store.merge)
    return store.read().withColumn("date", F.date_format("date", "yyyy-MM-dd"))
