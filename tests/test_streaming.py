"""Each stream must give what its batch form gives on the same rows, however they arrive."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickerloom.operators import ledger as L
from tickerloom.plans import stream_queries
from tickerloom.streaming import live

T0 = dt.datetime(2024, 1, 1)


def arrive(spark, path, frames):
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_bars_merge_across_batches_and_drop_late_ticks(spark, tmp_path):
    schema = "symbol string, ts timestamp, price double, volume bigint, seq bigint"
    at = lambda d, h: T0 + dt.timedelta(days=d, hours=h)
    frames = [spark.createDataFrame([("A", at(0, 9), 5.0, 1, 1), ("A", at(0, 10), 7.0, 1, 2)], schema),
              spark.createDataFrame([("A", at(0, 8), 4.0, 1, 0), ("A", at(9, 0), 1.0, 1, 3)], schema),
              spark.createDataFrame([("A", at(9, 1), 2.0, 1, 4)], schema),
              spark.createDataFrame([("A", at(0, 11), 99.0, 1, 5)], schema)]
    bars = live.stream_bars(arrive(spark, str(tmp_path / "in"), frames))
    out = str(tmp_path / "out")
    live.run_available(bars, out)
    rows = live.read_latest(spark, f"{out}/log", ["symbol", "start"], bars.schema).orderBy("start").collect()
    # The tick of the last batch is nine days late.
    assert [(r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in rows] == [(4, 7, 4, 7, 3), (1, 2, 1, 2, 2)]


@pytest.mark.parametrize("slices", [1, 4])
def test_ledger_stream_equals_batch(spark, tmp_path, slices):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STATE_STORE)
    rnd = random.Random(8)
    rows = [(rnd.choice([1, 1, 2]), i, T0 + dt.timedelta(minutes=i), rnd.choice("XY"), rnd.choice([*L.SIDES, "HOLD"]),
             float(rnd.randint(0, 4)), float(rnd.randint(1, 30))) for i in range(120)]
    schema = "user_id bigint, trade_id bigint, ts timestamp, symbol string, side string, quantity double, price double"
    df = spark.createDataFrame(rows, schema)
    users = spark.createDataFrame([(1, 300.0), (2, 300.0)], "user_id bigint, balance double")
    columns = ["trade_id", "status", "reject_reason", "realized_pnl", "balance_after"]
    want = sorted(L.replay_trades(df, users).filter("status <> 'OPENING'").select(columns).collect(), key=lambda r: r[0])
    # Trades arrive out of order by up to ten minutes; the last row lets the watermark pass.
    rnd.shuffle(rows)
    place = {r[1]: (r[1] + rnd.randrange(10)) * slices // 130 for r in rows}
    frames = [spark.createDataFrame([r for r in rows if place[r[1]] == i], schema) for i in range(slices)]
    frames.append(spark.createDataFrame([(-1, 999, T0 + dt.timedelta(days=9), None, None, None, None)], schema))
    out = live.stream_ledger(arrive(spark, str(tmp_path / "in"), frames), 300.0, "30 minutes")
    live.run_available(out, str(tmp_path / "out"), "append")
    got = spark.read.parquet(str(tmp_path / "out" / "table")).filter("user_id > 0").select(columns).collect()
    assert sorted(got, key=lambda r: r[0]) == want


def test_ledger_stream_keeps_few_timers_and_whole_pages(spark, tmp_path):
    """Many trades share a timer and a page, and users with more positions than lie beside a balance keep them all."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STATE_STORE)
    rnd = random.Random(3)
    schema = "user_id bigint, trade_id bigint, ts timestamp, symbol string, side string, quantity double, price double"
    names = [f"S{i}" for i in range(50)]
    rows = [(5, i, T0 + dt.timedelta(seconds=i), names[i % 50], "BUY" if i < 60 else rnd.choice(L.SIDES),
             float(rnd.randint(1, 3)), float(rnd.randint(1, 9))) for i in range(700)]
    rows += [(None, None, T0 + dt.timedelta(seconds=9), "X", "BUY", 1.0, 2.0), (6, 701, None, "X", "BUY", 1.0, 2.0)]
    users = spark.createDataFrame([(5, 2000.0)], "user_id bigint, balance double")
    columns = ["trade_id", "status", "reject_reason", "entry_price", "realized_pnl", "balance_after"]
    want = sorted(L.replay_trades(spark.createDataFrame(rows[:700], schema), users).filter(
        "status <> 'OPENING'").select(columns).collect(), key=lambda r: r[0])
    rnd.shuffle(rows)
    late = [r for r in rows if r[1] is not None and r[1] % 3 == 0 and r[1] > 300]
    frames = [spark.createDataFrame(part, schema) for part in (
        [r for r in rows if r not in late], late, [(-1, 999, T0 + dt.timedelta(days=9), None, None, None, None)])]
    out = live.stream_ledger(arrive(spark, str(tmp_path / "in"), frames), 2000.0, "10 minutes")
    query = live.run_available(out, str(tmp_path / "out"), "append")
    got = spark.read.parquet(str(tmp_path / "out" / "table"))
    assert sorted(got.filter("user_id = 5").select(columns).collect(), key=lambda r: r[0]) == want
    # The trade of nobody counts; the one without a time is dropped.
    assert [r[0] for r in got.filter("user_id IS NULL").select("balance_after").collect()] == [1998.0]
    assert got.filter("user_id = 6").count() == 0
    timers = [o["customMetrics"]["numRegisteredTimers"] for p in query.recentProgress for o in p["stateOperators"]]
    assert 0 < sum(timers) < 20


def test_a_replayed_table_is_computed_once(spark, tmp_path):
    """Bounds and slices of a replay read what one pass has written."""
    calls = spark.sparkContext.accumulator(0)

    def seen(x):
        calls.add(1)
        return x

    rows = spark.range(90, numPartitions=2).select(
        F.udf(seen, "bigint")("id").alias("user_id"), F.lit("S").alias("symbol"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"))
    path = str(tmp_path / "w")
    schema = stream_queries._replay(rows, "ts", "once", live.stream_watchlist, path, late_hours=3)
    assert live.read_latest(spark, f"{path}/log", ["user_id", "symbol"], schema).count() == 90
    assert calls.value == 90


def test_dedup_watchlist_and_signals(spark, tmp_path):
    arts = [(i, f"Title {i % 4}!", T0 + dt.timedelta(hours=i)) for i in range(12)]
    df = spark.createDataFrame(arts, "id bigint, title string, published timestamp")
    frames = [df.filter("id < 6"), df.filter("id >= 6")]
    out = live.stream_dedup(arrive(spark, str(tmp_path / "a"), frames))
    live.run_available(out, str(tmp_path / "ao"), "append")
    assert spark.read.parquet(str(tmp_path / "ao" / "table")).count() == 4

    ev = spark.createDataFrame([(1, "S", T0 + dt.timedelta(minutes=i)) for i in range(3)], "user_id bigint, symbol string, ts timestamp")
    state = live.stream_watchlist(arrive(spark, str(tmp_path / "w"), [ev.limit(2), ev.filter(F.col("ts") > T0 + dt.timedelta(minutes=1))]))
    live.run_available(state, str(tmp_path / "wo"))
    rows = live.read_latest(spark, str(tmp_path / "wo" / "log"), ["user_id", "symbol"], state.schema).collect()
    assert [(r["toggles"], r["listed"]) for r in rows] == [(3, True)]

    sig = spark.createDataFrame([("T", T0 + dt.timedelta(hours=6 * i), "earnings" if i % 2 else "filing", i / 4, 0.5) for i in range(8)],
                                "ticker string, published timestamp, category string, polarity double, semantic_score double")
    days = live.stream_daily_signals(arrive(spark, str(tmp_path / "s"), [sig.filter("polarity < 0.7"), sig.filter("polarity >= 0.7")]))
    live.run_available(days, str(tmp_path / "so"))
    got = live.read_latest(spark, str(tmp_path / "so" / "log"), ["ticker", "date"], days.schema).orderBy("date").collect()
    assert [(r["total_signals"], r["earnings_count"], r["general_count"], r["avg_sentiment_polarity"]) for r in got] == [
        (4, 2, 2, 0.375), (4, 2, 2, 1.375)]


def test_a_repeated_batch_is_written_once(spark, tmp_path):
    path = str(tmp_path / "log")
    write = live.upsert_sink(path)
    a = spark.createDataFrame([(1, 10.0)], "k bigint, v double")
    write(a, 0)
    write(a.withColumn("v", F.lit(11.0)), 1)
    write(a.withColumn("v", F.lit(12.0)), 1)
    assert [tuple(r) for r in live.read_latest(spark, path, ["k"], a.schema).collect()] == [(1, 12.0)]


def test_keyed_store_merges_only_what_a_batch_touches(spark, tmp_path):
    store = live.KeyedStore(spark, str(tmp_path / "t"), ["k"], "k bigint, v double, w string", F.concat(F.lit("p"), F.col("k") % 3))
    batch = lambda *rows: spark.createDataFrame(rows, "k bigint, v double, w string")
    table = lambda: sorted(tuple(r) for r in store.read().collect())
    assert table() == []
    store.merge(batch((1, 1.0, "a"), (2, 2.0, None), (3, 3.0, "c")), 0)
    store.merge(batch((1, 5.0, None), (4, 4.0, "d")), 1)
    assert table() == [(1, 5.0, None), (2, 2.0, None), (3, 3.0, "c"), (4, 4.0, "d")]
    # A repeated batch changes nothing, whatever it holds; later ones keep two folders of a partition.
    store.merge(batch((1, 9.0, "z")), 1)
    for epoch in range(2, 5):
        store.merge(batch((1, float(epoch), "e")), epoch)
    assert table() == [(1, 4.0, "e"), (2, 2.0, None), (3, 3.0, "c"), (4, 4.0, "d")]
    folders = {part: [e for e, _ in found] for part, found in store._folders().items()}
    assert folders == {"part=p1": [3, 4], "part=p2": [0], "part=p0": [0]}
    # A batch that stopped before its commit is not read, and is done again from the same state.
    names = store._names("_commits/epoch-4")
    store._fs().delete(spark._jvm.org.apache.hadoop.fs.Path(names[0]), True)
    assert table()[0] == (1, 3.0, "e")
    store.merge(batch((1, 7.0, "f"), (7, 7.0, "g")), 4)
    assert table() == [(1, 7.0, "f"), (2, 2.0, None), (3, 3.0, "c"), (4, 4.0, "d"), (7, 7.0, "g")]
    store.merge(batch(), 5)
    assert len(table()) == 5
