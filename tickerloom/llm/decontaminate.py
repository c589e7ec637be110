"""Benchmark passages in documents, by a prefix-filtered set join.

An item is cut into windows of ``WINDOW`` consecutive words.  Every window must occur
whole, so a prefix of one word is enough: its rarest one, by counts over all documents.
Documents are probed with their own words; a hit on a window's rarest word fixes where
the window would begin, the bounds of the document must hold all of it, and then all its
words are compared.

Documents are read where they lie and never shuffled.  The windows of a block of at most
``BLOCK_WINDOWS`` are broadcast (about 100 bytes each); a larger benchmark is joined block
after block, each against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import text_units as units
from tickerloom.llm.batches import Batches, map_batches, texts_of
from tickerloom.plans.stored import stored

WINDOW = 10
BLOCK_WINDOWS = 250_000
_SIEVE_BITS = 20


def words(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For stretches of texts: first and last text, hashes of their words, bounds of each text in them.

    A-Z become lower case; words are runs of digits, letters and all characters beyond ASCII.
    """
    for first, last in units.chunks(np.array([len(t) for t in texts], np.int64)):
        cp, bounds = units.lay_out(texts[first:last])
        cp = units.lower_ascii(cp)
        start, end = units.runs((cp >= 128) | ((cp >= 48) & (cp <= 57)) | ((cp >= 97) & (cp <= 122)), bounds)
        yield first, last, units.hashes(cp, start, end), np.searchsorted(start, bounds)


class Sieve:
    """Positions of the words that belong to a sorted list."""

    def __init__(self, wanted: np.ndarray) -> None:
        self.wanted = wanted
        self._marks = np.zeros(1 << _SIEVE_BITS, bool)
        self._marks[wanted >> np.uint64(64 - _SIEVE_BITS)] = True

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``names``, and in the list."""
        at = np.flatnonzero(self._marks[names >> np.uint64(64 - _SIEVE_BITS)])
        if not len(self.wanted):
            return at[:0], at[:0]
        where = np.minimum(np.searchsorted(self.wanted, names[at]), len(self.wanted) - 1)
        right = self.wanted[where] == names[at]
        return at[right], where[right]


@dataclass
class Index:
    """Windows of a block, ordered by their rarest word."""

    prefixes: np.ndarray  # distinct rarest words, sorted
    bounds: np.ndarray    # of each prefix's windows
    offset: np.ndarray    # of the rarest word in each window
    size: np.ndarray      # words of each window
    words: np.ndarray     # a row of words for each window
    items: list[list[str]]

    def occurrences(self, sieve: Sieve, names: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts in ``names`` and windows that lie there, inside one text."""
        at, prefix = sieve.find(names)
        many = self.bounds[prefix + 1] - self.bounds[prefix]
        window = np.repeat(self.bounds[prefix + 1] - np.cumsum(many), many) + np.arange(many.sum())
        at = np.repeat(at, many)
        text = np.searchsorted(bounds, at, side="right") - 1
        start = at - self.offset[window]
        fits = (start >= bounds[text]) & (start + self.size[window] <= bounds[text + 1])
        start, window = start[fits], window[fits]
        for k in range(self.words.shape[1]):
            inside = k < self.size[window]
            same = ~inside | (names[np.where(inside, start + k, 0)] == self.words[window, k])
            start, window = start[same], window[same]
        return start, window


def _windows(size: int, batches: Batches) -> Batches:
    for batch in batches:
        ids, items, found = batch.column("item").to_pylist(), [], []
        for first, last, names, bounds in words(texts_of(batch, "text")):
            for k in range(first, last):
                own = names[bounds[k - first]: bounds[k - first + 1]]
                for a in range(max(1, len(own) - size + 1) if len(own) else 0):
                    items.append(ids[k])
                    found.append(own[a: a + size].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(found, pa.binary())], ["item", "window"])


def _counts(wanted: Broadcast, batches: Batches) -> Batches:
    sieve = Sieve(wanted.value)
    total = np.zeros(len(sieve.wanted), np.int64)
    for batch in batches:
        for _, _, names, _ in words(texts_of(batch, "text")):
            total += np.bincount(sieve.find(names)[1], minlength=len(total))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(sieve.wanted[seen].view(np.int64)), pa.array(total[seen])], ["word", "n"])


def _blocks(texts: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, window: int,
            block_windows: int) -> Iterator[Broadcast]:
    """The index of each block of distinct windows."""
    spark = texts.sparkSession
    source = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    cut = stored(map_batches(source, partial(_windows, window), "item string, window binary")
                 .groupBy("window").agg(F.collect_set("item").alias("items")), "windows")
    blocks = max(1, -(-cut.count() // block_windows))
    for b in range(blocks):
        rows = cut.filter(F.expr(f"pmod(xxhash64(window), {blocks}) = {b}")).collect()
        size = np.array([len(r.window) // 8 for r in rows], np.int64)
        grid = np.zeros((len(rows), window), np.uint64)
        for i, r in enumerate(rows):
            grid[i, : size[i]] = np.frombuffer(r.window, np.uint64)
        inside = np.arange(window) < size[:, None]
        vocabulary = np.unique(grid[inside])
        counted = map_batches(texts, partial(_counts, spark.sparkContext.broadcast(vocabulary)), "word long, n long") \
            .groupBy("word").agg(F.sum("n").alias("n")).collect()
        frequency = np.zeros(len(vocabulary), np.int64)
        seen = np.array([r.word for r in counted], np.int64).view(np.uint64)
        frequency[np.searchsorted(vocabulary, seen)] = [r.n for r in counted]
        rank = np.empty(len(vocabulary), np.int64)
        rank[np.lexsort((vocabulary, frequency))] = np.arange(len(vocabulary))
        ranks = np.full(grid.shape, len(vocabulary))
        ranks[inside] = rank[np.searchsorted(vocabulary, grid[inside])]
        offset = ranks.argmin(axis=1) if len(rows) else np.zeros(0, np.int64)
        rarest = grid[np.arange(len(rows)), offset]
        order = np.argsort(rarest, kind="stable")
        prefixes, first = np.unique(rarest[order], return_index=True)
        yield spark.sparkContext.broadcast(Index(
            prefixes, np.append(first, len(rows)), offset[order], size[order], grid[order],
            [sorted(rows[i]["items"]) for i in order]))


def _hits(index: Index, sieve: Sieve, texts: list[str]) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
    """For each text: its words, the stretches of words inside windows, the items."""
    for first, last, names, bounds in words(texts):
        start, window = index.occurrences(sieve, names, bounds)
        cover = np.zeros(len(names) + 1, np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + index.size[window], -1)
        opens, closes = units.runs(np.cumsum(cover[:-1]) > 0, bounds)
        text = np.searchsorted(bounds, start, side="right") - 1
        items: dict[int, set[str]] = {}
        for t, w in zip(text.tolist(), window.tolist()):
            items.setdefault(t, set()).update(index.items[w])
        spans: dict[int, list[tuple[int, int]]] = {}
        for t, a, b in zip((np.searchsorted(bounds, opens, side="right") - 1).tolist(), opens.tolist(), closes.tolist()):
            spans.setdefault(t, []).append((a - int(bounds[t]), b - int(bounds[t])))
        for k in range(last - first):
            yield int(bounds[k + 1] - bounds[k]), spans.get(k, []), items.get(k, set())


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _report(found: Broadcast, batches: Batches) -> Batches:
    index = found.value
    sieve = Sieve(index.prefixes)
    for batch in batches:
        rows = list(_hits(index, sieve, texts_of(batch, "text")))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("copy"), pa.array([r[0] for r in rows], pa.int64()),
             pa.array([[{"first": a, "last": b} for a, b in r[1]] for r in rows], _SPANS),
             pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string()))],
            ["doc_id", "copy", "n_words", "spans", "items"])


def _keep(found: Broadcast, text_col: str, batches: Batches) -> Batches:
    index = found.value
    sieve = Sieve(index.prefixes)
    for batch in batches:
        clean = [not spans for _, spans, _ in _hits(index, sieve, texts_of(batch, text_col))]
        yield batch.filter(pa.array(clean, pa.bool_()))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """Each row of ``docs`` with ``n_words``, ``spans``, ``items``, ``n_hit`` and ``contaminated``.

    ``spans`` are the stretches of word positions (last one exclusive) inside any window
    that occurs, ``items`` the sorted ids, as strings, of the items they belong to.  An item of fewer
    words than ``window`` is one window, one without words none.  Null and empty texts have
    no words; a null id is kept, an item without id hits but is not listed; rows that
    repeat are judged each; other columns are left out; without items nothing is hit.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = texts.withColumn("copy", F.xxhash64("text"))
    report = None
    for found in _blocks(texts.select("text"), benchmark, item_col, item_text_col, window, block_windows):
        part = map_batches(rows, partial(_report, found),
                           "doc_id long, copy long, n_words long, spans array<struct<first: long, last: long>>, "
                           "items array<string>")
        if report is None:
            report = part
            continue
        more = part.filter("size(spans) > 0").dropDuplicates(["doc_id", "copy"]).select(
            F.col("doc_id").alias("d"), F.col("copy").alias("c"), F.col("spans").alias("s"), F.col("items").alias("i"))
        report = report.join(more, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("copy").eqNullSafe(F.col("c")), "left") \
            .select("doc_id", "copy", "n_words",
                    F.concat("spans", F.coalesce("s", F.expr("slice(spans, 1, 0)"))).alias("spans"),
                    F.array_sort(F.array_union("items", F.coalesce("i", F.expr("slice(items, 1, 0)")))).alias("items"))
    n_hit = F.expr("""aggregate(array_sort(spans), struct(0L AS n, 0L AS upto),
        (a, x) -> struct(a.n + greatest(0L, x.last - greatest(x.first, a.upto)), greatest(a.upto, x.last)), a -> a.n)""")
    return report.select("doc_id", "n_words", "spans", "items", n_hit.alias("n_hit"),
                         (F.size("spans") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS,
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of an item occurs.

    Rows are judged one by one by their own text; null, empty and blank texts have no words
    and stay.  Items without words have no windows; an empty benchmark keeps every row.
    """
    kept = docs
    for b, found in enumerate(_blocks(docs.select(F.col(text_col).alias("text")), benchmark, item_col, item_text_col,
                                      window, block_windows)):
        # A worker holds one block: passes are apart.
        kept = map_batches(stored(kept, "decontaminated") if b else kept, partial(_keep, found, text_col), docs.schema)
    return kept
