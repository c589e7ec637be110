"""Near-duplicate documents by HyperMinHash sketches, bands and exact confirmation.

1. A document becomes its set of word shingles, as 64-bit hashes, and a sketch of it: the
   smallest value of each of ``REGISTERS`` hash functions, kept as a number of leading
   zeros and ten mantissa bits.  Every register sees the whole set.  (Dealing one hash
   over buckets would leave most registers of a short text empty, and texts that share
   one sentence would then agree in whole bands.)
2. Documents with equal sets are one class from here on, named by its smallest id.
3. Classes that agree in all registers of a band meet.  They are compared by sketch, the
   estimate corrected for registers that agree by accident; pairs clearly below the
   threshold end here, the others tie classes into clusters.
4. In each cluster, sets built again from the texts confirm links, likeliest pairs first;
   a pair that is already connected needs no test.
5. Components of the confirmed links name the groups.

Groups and clusters of more than ``CELL_ROWS`` classes are cut into blocks, and each two
blocks meet in a task of their own.  A task emits at most one edge for each of its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import text_units as units
from tickerloom.llm.batches import Batches, map_batches, sorted_groups, texts_of
from tickerloom.llm.components import connected_components
from tickerloom.plans.stored import stored

REGISTERS = 160
BAND_ROWS = 5
MANTISSA = 10
#: Standard errors that an estimate may lie below the threshold before a pair is dropped.
ERRORS = 5
#: Classes, and bytes of their sets, that one block of a group may hold.
CELL_ROWS = 1024
CELL_BYTES = 16 << 20


def shingle_sets(texts: list[str], words: int) -> Iterator[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text.

    A-Z become lower case; words are runs of anything but blanks and the control
    characters 9 to 13.  A text of fewer words is one shingle, one without words none.
    """
    for first, last in units.chunks(np.array([len(t) for t in texts], np.int64)):
        cp, bounds = units.lay_out(texts[first:last])
        cp = units.lower_ascii(cp)
        start, end = units.runs(~((cp == 32) | ((cp >= 9) & (cp <= 13))), bounds)
        names = units.hashes(cp, start, end)
        at = np.searchsorted(start, bounds)
        joined = names[: max(0, len(names) - words + 1)]
        for j in range(1, words):
            joined = units.mix(joined * np.uint64(31) + names[j: len(names) - words + 1 + j])
        for a, b in zip(at, at[1:]):
            if b - a >= words:
                found = np.sort(joined[a: b - words + 1])
                yield found[np.concatenate(([True], found[1:] != found[:-1]))]
            elif b > a:
                whole = hashlib.blake2b(names[a:b].tobytes(), digest_size=8).digest()
                yield np.frombuffer(whole, np.uint64)
            else:
                yield np.zeros(0, np.uint64)


@cache
def _functions() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of the registers' hash functions, from a counter."""
    drawn = units.mix(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (drawn[:REGISTERS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), \
        (drawn[REGISTERS:] >> np.uint64(32)).astype(np.uint32)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of a set: leading zeros of each smallest value, then its next bits."""
    factor, offset = _functions()
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(short), 1024):
        values = short[a: a + 1024, None] * factor
        values += offset
        np.minimum(least, values.min(axis=0), out=least)
    bits = (least.astype(np.float64) + 1).view(np.uint64) >> np.uint64(52 - MANTISSA)
    exponent = (bits >> np.uint64(MANTISSA)) - np.uint64(1023)
    return ((np.uint64(32) - exponent) << np.uint64(MANTISSA) | bits & np.uint64((1 << MANTISSA) - 1)).astype(np.uint16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    bands = registers.reshape(-1, BAND_ROWS).astype(np.uint64)
    key = np.arange(len(bands), dtype=np.uint64)
    for j in range(BAND_ROWS):
        key = units.mix(key * np.uint64(65599) + bands[:, j])
    return key.view(np.int64)


def estimate(one: np.ndarray, other: np.ndarray, n_one: np.ndarray, n_other: np.ndarray) -> np.ndarray:
    """Similarities of every row of ``one`` with every row of ``other``.

    Registers of unrelated sets agree by accident with a probability that is largest for
    sets of one size (0.17 of the mantissa's share); that part is taken out.
    """
    same = np.empty((len(one), len(other)), np.float64)
    step = max(1, (1 << 24) // max(1, other.size))
    for a in range(0, len(one), step):
        same[a: a + step] = (one[a: a + step, None, :] == other[None, :, :]).sum(axis=2)
    ratio = np.minimum(n_one[:, None], n_other[None, :]) / np.maximum(np.maximum(n_one[:, None], n_other[None, :]), 1)
    chance = 0.17 / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    return (same / one.shape[1] - chance) / (1 - chance)


def _sketches(words: int, id_col: str, text_col: str, batches: Batches) -> Batches:
    for batch in batches:
        rows = [(len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), r.tobytes(), band_keys(r)) if len(s)
                else (0, None, None, None)
                for s in shingle_sets(texts_of(batch, text_col), words) for r in (sketch(s),)]
        n, digest, registers, keys = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(id_col).cast(pa.int64()), batch.column("copy"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
             pa.array(registers, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
            ["doc_id", "copy", "n", "digest", "registers", "keys"])


class _Forest:
    def __init__(self, n: int) -> None:
        self.above = list(range(n))

    def root(self, i: int) -> int:
        while self.above[i] != i:
            self.above[i] = self.above[self.above[i]]
            i = self.above[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.above[max(i, j)] = min(i, j)
        return i != j


def _candidates(registers: np.ndarray, n: np.ndarray, block: np.ndarray, percent: int,
                least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a cell that may be similar, likeliest first."""
    low = np.flatnonzero(block == block.min())
    high = np.flatnonzero(block == block.max())
    close = estimate(registers[low], registers[high], n[low], n[high])
    a, b = n[low][:, None], n[high][None, :]
    close[100 * np.minimum(a, b) < percent * np.maximum(a, b)] = 0
    if block.min() == block.max():
        close[np.tril_indices(len(low))] = 0
    i, j = np.nonzero(close >= least)
    best = np.argsort(-close[i, j], kind="stable")
    return low[i[best]], high[j[best]]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _compare(percent: int, least: float, batches: Batches) -> Batches:
    """Likely pairs of each cell, without those that earlier pairs connect."""
    for table, ranges in sorted_groups(batches, ["key", "low", "high"]):
        registers, n = _matrix(table.column("registers")), table.column("n").to_numpy()
        ids, block = table.column("id").to_numpy(), table.column("block").to_numpy()
        found = []
        for a, b in ranges:
            if b - a == 1:
                continue
            forest = _Forest(b - a)
            for i, j in zip(*_candidates(registers[a:b], n[a:b], block[a:b], percent, least)):
                if forest.join(i, j):
                    found.append((ids[a + i], ids[a + j]))
        yield _edges(found)


def _confirm(percent: int, least: float, batches: Batches) -> Batches:
    """Links of each cell that whole sets confirm, without those that others imply."""
    for table, ranges in sorted_groups(batches, ["key", "low", "high"]):
        registers, n = _matrix(table.column("registers")), table.column("n").to_numpy()
        ids, block = table.column("id").to_numpy(), table.column("block").to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        found = []
        for a, b in ranges:
            if b - a == 1:
                continue
            forest = _Forest(b - a)
            for i, j in zip(*_candidates(registers[a:b], n[a:b], block[a:b], percent, least)):
                if forest.root(i) == forest.root(j):
                    continue
                one, other = sets[a + i], sets[a + j]
                at = np.searchsorted(one, other)
                at[at == len(one)] = 0
                both = int((one[at] == other).sum())
                if 100 * both >= percent * (len(one) + len(other) - both):
                    forest.join(i, j)
                    found.append((ids[a + i], ids[a + j]))
        yield _edges(found)


def _cells(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of each group in blocks, each row once for every two blocks that meet.

    ``sizes`` has a row per group (``key``) with its number of ``blocks``.
    """
    dealt = rows.join(sizes, "key").withColumn("block", F.expr("pmod(xxhash64(id), blocks)"))
    cells = dealt.select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")).withColumns({
        "low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "blocks")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(parts, "key", "low", "high").sortWithinPartitions("key", "low", "high", "id")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Each row of ``docs`` with ``n_shingles``, ``component_id`` and ``kept``.

    Documents are linked when their shared shingles are at least ``percent`` of all
    shingles of both.  ``component_id`` is the smallest id reachable by links, ``kept`` marks
    the document of that id.  Null, empty and blank texts have no shingles and no links.
    A row without id is kept, with a null component, and links nothing.  Rows that repeat an id are
    judged by their own text.  Other columns are left out; no rows give no rows.
    """
    return _judged(docs, shingle_words, percent, id_col, text_col).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies: of the smallest id, then of the smallest hash of its text.

    Rows that repeat an id are judged by their own text, so an id may lose one text and
    keep another; of rows with equal id and text one stays.  Rows without id and texts
    without words all stay, repeats included.  Other columns are kept as they are; no rows
    give no rows.
    """
    judged = stored(_judged(docs, shingle_words, percent, id_col, text_col).filter("group IS NOT NULL").select(
        "doc_id", "copy", "group"), "near_groups")
    best = judged.groupBy("group").agg(F.min(F.struct("doc_id", "copy")).alias("best"))
    # A text of an id is in one group, so id and hash tell what becomes of its rows.
    fate = judged.groupBy("group", "doc_id", "copy").agg(F.count("*").alias("times")).join(best, "group").select(
        F.col("doc_id").alias("__doc"), F.col("copy").alias("__copy"),
        (F.struct("doc_id", "copy") != F.col("best")).alias("__gone"), (F.col("times") > 1).alias("__repeated"),
    ).filter("__gone OR __repeated")
    doc, copy = F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.col(f"`{text_col}`"))
    left = docs.join(fate, (doc == F.col("__doc")) & (copy == F.col("__copy")), "left").filter("NOT coalesce(__gone, false)")
    once = left.filter("NOT coalesce(__repeated, false)")
    return once.unionByName(left.filter("__repeated").dropDuplicates(["__doc", "__copy"])).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def _judged(docs: DataFrame, shingle_words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``copy`` (a hash of the text), ``n``, ``group`` (null without links or id) and ``component_id`` of each row.

    Groups are of texts, not of ids: an id that repeats with different texts does not tie them.
    """
    share = percent / 100
    least = share - ERRORS * (share * (1 - share) / REGISTERS) ** 0.5
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("copy"),
                         F.col(f"`{text_col}`").alias("text"))
    marked = stored(map_batches(source, partial(_sketches, shingle_words, "doc_id", "text"),
                                "doc_id long, copy long, n long, digest binary, registers binary, keys array<long>"), "sketches")
    # Classes are numbered as they are written; ``doc`` is the smallest id.
    classes = stored(
        marked.filter("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(
            F.min("doc_id").alias("doc"), F.any_value("n").alias("n"), F.any_value("registers").alias("registers"),
            F.any_value("keys").alias("keys")).withColumn("id", F.monotonically_increasing_id()), "classes")

    met = classes.select("id", F.explode("keys").alias("key"))
    sizes = met.groupBy("key").agg(F.count("id").alias("rows")).filter("rows > 1").select(
        "key", F.ceil(F.col("rows") / CELL_ROWS).alias("blocks"))
    sketched = classes.select("id", "n", "registers")
    likely = map_batches(
        _cells(met.join(sizes.select("key"), "key", "left_semi").join(sketched, "id"), sizes)
        .select("key", "low", "high", "block", "id", "n", "registers"),
        partial(_compare, percent, least), "u long, v long")
    clusters = stored(connected_components(likely).select(F.col("node").alias("id"), F.col("component").alias("key")),
                      "clusters")

    sizes = clusters.join(sketched.select("id", "n"), "id").groupBy("key").agg(
        F.ceil(F.greatest(F.count("id") / CELL_ROWS, F.sum("n") * 8 / CELL_BYTES)).alias("blocks"))
    chosen = classes.select("id", "doc", "n", "registers", "digest").join(clusters, "id")
    read = source.join(chosen, source.doc_id == chosen.doc).select("key", "id", "n", "registers", "digest", "text")
    # Equal rows of one id give a set twice, which changes no link.
    sets = map_batches(read, partial(_sets, shingle_words), "key long, id long, n long, registers binary, shingles binary")
    links = map_batches(
        _cells(sets, sizes).select("key", "low", "high", "block", "id", "n", "registers", "shingles"),
        partial(_confirm, percent, least), "u long, v long")
    components = connected_components(links)

    named = classes.select("digest", "id", "doc").join(components, classes.id == components.node, "left").select(
        "digest", "doc", F.coalesce("component", "id").alias("group"))
    smallest = named.groupBy("group").agg(F.min("doc").alias("component_id"))
    # A row without id has the class of its text, if there is one, but no place in the group.
    return marked.join(named.drop("doc").join(smallest, "group"), "digest", "left").select(
        "doc_id", "copy", "n", F.when(F.col("doc_id").isNotNull(), F.col("group")).alias("group"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _sets(words: int, batches: Batches) -> Batches:
    """Sets of the texts that stand for their class."""
    for batch in batches:
        keep, sets = [], []
        wanted = batch.column("digest").to_pylist()
        for i, s in enumerate(shingle_sets(texts_of(batch, "text"), words)):
            if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == wanted[i]:
                keep.append(i)
                sets.append(s.tobytes())
        rows = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*(rows.column(c) for c in ("key", "id", "n", "registers")), pa.array(sets, pa.binary())],
            ["key", "id", "n", "registers", "shingles"])
