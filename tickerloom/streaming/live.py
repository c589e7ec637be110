"""Online forms of the batch operators: bars, ledger, dedup, watchlist, daily signals, upserts."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from tickerloom.functions import fixed_values as fixed
from tickerloom.functions.text import title_key
from tickerloom.operators.ledger import SIDES, _Book

# Fixed value: balance of a user seen for the first time.
START_BALANCE = 100000.0

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

LEDGER_STREAM_SCHEMA = (
    "user_id bigint, trade_id bigint, ts timestamp, symbol string, side string, quantity double, price double, "
    "status string, reject_reason string, entry_price double, realized_pnl double, balance_after double"
)


def stream_bars(ticks: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Bars of ``ticks(symbol, ts, price, volume, seq)`` by event time; later ticks than ``late`` are dropped."""
    at = F.struct("ts", "seq")
    bars = ticks.withWatermark("ts", late).groupBy(F.window("ts", width), "symbol").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum("volume").cast("bigint").alias("volume"))
    return bars.select("symbol", F.col("window.start").alias("start"), "open", "high", "low", "close", "volume")


# Users are dealt into buckets that share a timer and pages of waiting trades.  Fixed for a checkpoint.
BUCKETS = 1024
PAGE = 256
# Positions of a user that are stored beside the balance.
NEAR = 32
# Decided trades that leave at once, and after which books go back to the state store.
CHUNK = 10000

_PAGE_SCHEMA = (
    "at array<bigint>, trade_id array<bigint>, user_id array<bigint>, symbol array<string>, side array<string>, "
    "quantity array<double>, price array<double>"
)
_BOOK_SCHEMA = "balance double, others bigint, symbol array<string>, quantity array<double>, avg_cost array<double>"
_DECIDED_SCHEMA = LEDGER_STREAM_SCHEMA.replace("ts timestamp", "at bigint")
_DECIDED = [c.split()[0] for c in _DECIDED_SCHEMA.split(", ")]


def _order(trade: tuple) -> tuple[int, bool, int]:
    """Trades go by time, then by id, those without an id first."""
    return trade[0], trade[1] is not None, trade[1] or 0


class _StoredPositions:
    """A user's positions: up to ``NEAR`` of them beside the balance, the others in a state of their own, by symbol.

    Of the others only the symbols at hand are read, and only those that changed are written.
    """

    def __init__(self, state, user_id: int | None, near: dict[str, tuple[float, float]], others: int) -> None:
        self.state, self.user_id, self.near, self.others = state, user_id, near, others
        self.far, self.far_changed, self.changed = {}, set(), False

    def _other(self, symbol: str) -> tuple[float, float] | None:
        if symbol not in self.far:
            if not self.others:
                return None
            held = self.state.getValue((self.user_id, symbol))
            self.far[symbol] = None if held is None else tuple(held)
        return self.far[symbol]

    def get(self, symbol: str, default: tuple[float, float]) -> tuple[float, float]:
        held = self.near.get(symbol) or self._other(symbol)
        return default if held is None else held

    def __setitem__(self, symbol: str, position: tuple[float, float]) -> None:
        self.changed = True
        if symbol in self.near or self._other(symbol) is None and len(self.near) < NEAR:
            self.near[symbol] = position
            return
        if self._other(symbol) is None:
            self.others += 1
        self.far[symbol] = position
        self.far_changed.add(symbol)

    def __delitem__(self, symbol: str) -> None:
        self.changed = True
        if symbol in self.near:
            del self.near[symbol]
            return
        self.others -= 1
        self.far[symbol] = None
        self.far_changed.add(symbol)

    def save_others(self) -> None:
        for symbol in self.far_changed:
            if self.far[symbol] is None:
                self.state.removeKey((self.user_id, symbol))
            else:
                self.state.updateValue((self.user_id, symbol), self.far[symbol])


class LedgerProcessor(StatefulProcessor):
    """Decides the trades of a bucket of users in the order of their time, however they arrive.

    Trades wait in pages, each sorted by time; the directory has the first time of each page, and the
    earliest one has the bucket's timer.  When the watermark passes it, the trades before the watermark
    are merged from the pages and decided; a page is read when the merge reaches its first trade, so no more
    are held than overlap at one time.  Each user's book is read and written once for many trades.
    """

    def __init__(self, balance: float = START_BALANCE):
        self.start = balance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.directory = handle.getValueState("directory", "page array<bigint>, first array<bigint>")
        self.waiting = handle.getMapState("waiting", "page bigint", _PAGE_SCHEMA)
        self.books = handle.getMapState("books", "user_id bigint", _BOOK_SCHEMA)
        self.others = handle.getMapState("others", "user_id bigint, symbol string", "quantity double, avg_cost double")

    def _pages(self) -> dict[int, int]:
        saved = self.directory.get()
        return {} if saved is None else dict(zip(*saved))

    def _keep(self, pages: dict[int, int], timer: int | None) -> None:
        """Writes the directory and moves the timer from ``timer`` to the earliest trade's millisecond."""
        if pages:
            self.directory.update((list(pages), list(pages.values())))
        else:
            self.directory.clear()
        first = min(pages.values()) // 1000 if pages else None
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pages = self._pages()
        timer = min(pages.values()) // 1000 if pages else None
        last = max(pages, default=-1)
        for frame in rows:
            ids = ([int(x) if isinstance(x, str) else None for x in frame[c]] for c in ("trade_id", "user_id"))
            texts = ([x if isinstance(x, str) else None for x in frame[c]] for c in ("symbol", "side"))
            numbers = ([None if x != x else x for x in frame[c].astype("float64").tolist()] for c in ("quantity", "price"))
            trades = sorted(zip(frame["at"].tolist(), *ids, *texts, *numbers), key=_order)
            for begin in range(0, len(trades), PAGE):
                last += 1
                self._write(last, trades[begin:begin + PAGE], pages)
        self._keep(pages, timer)
        return iter(())

    def _write(self, page: int, trades: list[tuple], pages: dict[int, int]) -> None:
        self.waiting.updateValue((page,), tuple(list(column) for column in zip(*trades)))
        pages[page] = trades[0][0]

    def _book(self, user_id: int | None) -> _Book:
        book, saved = _Book(user_id), self.books.getValue((user_id,))
        book.balance, others, symbols, *sizes = (self.start, 0, [], [], []) if saved is None else saved
        book.positions = _StoredPositions(self.others, user_id, dict(zip(symbols, zip(*sizes))), others)
        return book

    def _save(self, books: dict[int | None, _Book]) -> None:
        for user_id, book in books.items():
            held = book.positions
            if held.changed:
                sizes = [[position[i] for position in held.near.values()] for i in (0, 1)]
                self.books.updateValue((user_id,), (book.balance, held.others, list(held.near), *sizes))
                held.save_others()
        books.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = 1000 * max(expiredTimerInfo.getExpiryTimeInMs() + 1, timerValues.getCurrentWatermarkInMs())
        pages = self._pages()
        unread = sorted(((first, page) for page, first in pages.items() if first < end), reverse=True)
        books, out = {}, []
        heap: list[tuple[tuple, int, int, list[tuple]]] = []
        while heap or unread:
            while unread and (not heap or unread[-1][0] <= heap[0][0][0]):
                page = unread.pop()[1]
                trades = list(zip(*self.waiting.getValue((page,))))
                heapq.heappush(heap, (_order(trades[0]), page, 0, trades))
            _, page, place, trades = heap[0]
            at, trade, user_id, symbol, side, quantity, price = trades[place]
            if at >= end:
                break
            if user_id not in books:
                books[user_id] = self._book(user_id)
            book = books[user_id]
            entry = pnl = None
            if not symbol or not side or not quantity or not price:
                reason = "missing_field"
            elif side not in SIDES:
                reason = "invalid_side"
            else:
                reason, entry, pnl = book.apply(symbol, side, quantity, price)
            out.append((user_id, trade, at, symbol, side, quantity, price,
                        "REJECTED" if reason else "COMPLETED", reason, entry, pnl, book.balance))
            if place + 1 < len(trades):
                heapq.heapreplace(heap, (_order(trades[place + 1]), page, place + 1, trades))
            else:
                heapq.heappop(heap)
                self.waiting.removeKey((page,))
                del pages[page]
            if len(out) == CHUNK:
                self._save(books)
                yield self._frame(out)
                out = []
        for _, page, place, trades in heap:
            self._write(page, trades[place:], pages)
        self._save(books)
        # The expired timer goes by itself.
        self._keep(pages, None)
        if out:
            yield self._frame(out)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=_DECIDED)
        for i in (0, 1):
            frame[_DECIDED[i]] = pd.array([row[i] for row in rows], dtype="Int64")
        return frame

    def close(self) -> None:
        pass


def stream_ledger(trades: DataFrame, balance: float = START_BALANCE, late: str = "1 day") -> DataFrame:
    """Accepted and rejected trades in the order of their time, once the watermark has passed them.

    A trade may arrive up to ``late`` after a later one; those later still, and trades
    without a time, are dropped, as from any stream with a watermark.
    """
    # Ids travel as text: pandas would read a column with nulls as floats.
    named = trades.filter(F.col("ts").isNotNull()).withWatermark("ts", late).select(
        F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).alias("bucket"), "ts", F.unix_micros("ts").alias("at"),
        *[F.col(c).cast("string").alias(c) for c in ("user_id", "trade_id")], "symbol", "side", "quantity", "price")
    decided = named.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=LedgerProcessor(balance), outputStructType=_DECIDED_SCHEMA,
        outputMode="Append", timeMode="EventTime")
    return decided.withColumn("at", F.timestamp_micros("at")).withColumnRenamed("at", "ts")


def stream_dedup(articles: DataFrame, ts: str = "published", late: str = "14 days") -> DataFrame:
    """First article per title key within the watermark."""
    return articles.withColumn("title_key", title_key("title")).withWatermark(ts, late) \
        .dropDuplicatesWithinWatermark(["title_key"])


def stream_watchlist(events: DataFrame) -> DataFrame:
    """Running toggle count per (user, symbol); an odd count means listed."""
    counts = events.groupBy("user_id", "symbol").agg(F.count(F.lit(1)).alias("toggles"), F.max("ts").alias("added_at"))
    return counts.withColumn("listed", F.col("toggles") % 2 == 1)


def stream_daily_signals(articles: DataFrame, late: str = "2 days") -> DataFrame:
    """Counts and means per ticker and day of ``articles(ticker, published, category, polarity, semantic_score)``."""
    c = F.col("category")
    bucket = F.when(c.isin(fixed.SIGNAL_BUCKETS), c).otherwise("general")
    rows = articles.withWatermark("published", late).groupBy(F.window("published", "1 day"), "ticker").agg(
        F.count(F.lit(1)).alias("total_signals"), F.avg("polarity").alias("avg_sentiment_polarity"),
        F.avg("semantic_score").alias("avg_semantic_impact"),
        *[F.count_if(bucket == b).alias(f"{b}_count") for b in fixed.SIGNAL_BUCKETS])
    return rows.select("ticker", F.to_date("window.start").alias("date"), *rows.columns[2:])


def upsert_sink(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: each batch is one folder of a change log.

    A repeated batch replaces its own folder, so a restart after a lost driver or
    executor writes nothing twice.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch:09d}")

    return write


def read_latest(spark: SparkSession, path: str, keys: list[str], schema: str | StructType) -> DataFrame:
    """Last written row of each key in a change log."""
    log = spark.read.schema(schema).option("basePath", path).parquet(f"{path}/*")
    values = [c for c in log.columns if c not in (*keys, "epoch")]
    epoch = F.regexp_extract(F.col("_metadata.file_path"), r"epoch=(\d+)", 1).cast("bigint")
    last = log.select(*keys, *values, epoch.alias("_e")).groupBy(*keys).agg(
        F.max_by(F.struct(*values), "_e").alias("v"))
    return last.select(*keys, "v.*")


class KeyedStore:
    """A table of one row per key that batches are merged into, for ``foreachBatch``.

    The table is cut by ``partition``, a text that the keys determine (a month, say).  A batch
    reads and rewrites only the partitions it touches: each as a new folder named by the
    batch's epoch, from the newest committed folder before it and the batch's rows.  A batch
    counts from the moment its commit file is there, so a stopped one leaves no trace for
    readers, and a repeated one writes its own folders again from the same state.
    Folders that no reader can need any more are removed: all but the newest two.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str | StructType, partition: Column) -> None:
        self.spark, self.path, self.keys, self.partition = spark, path, keys, partition
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.values = [f.name for f in self.schema if f.name not in keys]

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, pattern: str) -> list[str]:
        found = self._fs().globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}"))
        return [f.getPath().toString() for f in found or ()]

    def committed(self) -> list[int]:
        return sorted(int(name.rsplit("-", 1)[1]) for name in self._names("_commits/epoch-*"))

    def _folders(self, before: int | None = None) -> dict[str, list[tuple[int, str]]]:
        """Committed folders of each partition, oldest first."""
        epochs = {e for e in self.committed() if before is None or e < before}
        out: dict[str, list[tuple[int, str]]] = {}
        for name in self._names("part=*/epoch=*"):
            part, epoch = name.rsplit("/", 2)[1:]
            if int(epoch.removeprefix("epoch=")) in epochs:
                out.setdefault(part, []).append((int(epoch.removeprefix("epoch=")), name))
        return {part: sorted(found) for part, found in out.items()}

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self) -> DataFrame:
        """The table: one row per key."""
        return self._read([found[-1][1] for found in self._folders().values()])

    def merge(self, batch: DataFrame, epoch: int) -> None:
        """Rows of ``batch`` replace those of their keys; it has one row per key.  Nothing happens twice."""
        if epoch in self.committed():
            return
        new = batch.select(*self.keys, *self.values).withColumn("part", self.partition)
        new.persist()
        try:
            touched = {f"part={r[0]}" for r in new.select("part").distinct().collect()}
            known = self._folders(before=epoch)
            old = self._read([known[p][-1][1] for p in touched if p in known]).withColumn("part", self.partition)
            merged = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))).groupBy(
                "part", *self.keys).agg(F.max_by(F.struct(*self.values), "_new").alias("_v")).select(
                    *self.keys, "_v.*", "part", F.lit(epoch).alias("epoch"))
            merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "epoch").parquet(
                self.path)
        finally:
            new.unpersist()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        self._fs().create(path(f"{self.path}/_commits/epoch-{epoch}"), True).close()
        for part, found in self._folders().items():
            if part in touched:
                for _, name in found[:-2]:
                    self._fs().delete(path(name), True)


def run_available(df: DataFrame, path: str, mode: str = "update", sink: Callable | None = None) -> StreamingQuery:
    """Process everything available now into a change log or an appended table, and wait."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if sink is None and mode == "append":
        query = writer.format("parquet").start(f"{path}/table")
    else:
        query = writer.foreachBatch(sink or upsert_sink(f"{path}/log")).start()
    query.awaitTermination()
    return query
