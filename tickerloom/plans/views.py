"""The given tables seen as market, portfolio and news entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.operators.bars import bars_from_ticks

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TICK_ORDER = ("ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


def eod_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trades of their part's brand."""
    items = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    return items.join(parts, items["l_partkey"] == parts["p_partkey"]).select(
        "symbol",
        F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"),
        *TICK_ORDER[1:],
    )


def eod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_ticks(eod_ticks(spark, sf_dir), "day", TICK_ORDER)


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("value").alias("price"),
        _k().alias("volume"),
        "event_id",
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = (
        F.when(F.col("event_type") == "purchase", "BUY")
        .when(F.col("event_type") == "view", "SELL")
        .when(F.col("event_type") == "click", "SHORT")
        .when(F.col("event_type") == "error", "COVER")
    )
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("event_type") != "signup")
        .select(
            "user_id",
            F.col("event_id").alias("trade_id"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.concat(F.lit("S"), _k() % 3).alias("symbol"),
            side.alias("side"),
            (_k() % 10 + 1).cast("double").alias("quantity"),
            F.col("value").alias("price"),
        )
    )


def trade_users(spark: SparkSession, sf_dir: str, balance: float = 2000.0) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.withColumn("balance", F.lit(balance))


def trade_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest price per traded symbol."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.concat(F.lit("S"), _k() % 3).alias("symbol"))
        .agg(F.max_by("value", F.struct("ts", "event_id")).alias("last_price"))
    )


def watch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("event_type") == "signup")
        .select("user_id", F.concat(F.lit("S"), _k() % 3).alias("symbol"),
                F.col("ts").cast("timestamp").alias("ts"), "event_id")
    )


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open positions of customers: returned items count as short."""
    items = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    rows = items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).join(
        parts, items["l_partkey"] == parts["p_partkey"]
    )
    qty, cost = F.sum("l_quantity"), F.sum("l_extendedprice")
    short = F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)) == 1
    return rows.groupBy("user_id", "symbol").agg(
        F.when(short, "SHORT").otherwise("LONG").alias("side"),
        qty.alias("quantity"),
        (F.round(cost, 2) / qty).alias("avg_cost"),
    )


def customer_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("balance"))


def eod_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last tick and first tick of each brand as last price and previous close."""
    at = F.struct(*TICK_ORDER)
    return eod_ticks(spark, sf_dir).groupBy("symbol").agg(
        F.max_by("price", at).alias("last_price"),
        F.min_by("price", at).alias("previous_close"),
        F.sum("volume").cast("bigint").alias("volume"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One equity value per customer and order day."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("date").alias("date"))
        .agg(F.round(F.sum("o_totalprice"), 2).alias("equity"))
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles; the whole text is the summary."""
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        doc.alias("id"),
        F.concat(F.lit("T"), doc % 25).alias("ticker"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("summary"),
        "source",
        "lang",
        F.date_add(F.lit("2024-01-01").cast("date"), (doc % 30).cast("int")).alias("published"),
        F.concat_ws("/", "source", doc).alias("url"),
    )
