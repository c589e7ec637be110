"""Shards of near-equal bytes by a k-d tree over metadata.

Every row gets a coordinate in each dimension: the value's place in the upper bits, and a
hash of the row below, so that rows of one value (a hot source, a language, a group of
equal texts) can still be cut between.  A node is split at the weighted median of the
dimension in which it is widest, weighted by bytes and by the number of shards that each
side will hold.  Medians come from histograms: one aggregate over all rows counts the
bytes of every node in ``BINS`` bins, and the bin that holds the median is cut again until
it holds less than ``TOLERANCE`` of a shard.  Only those counts reach the driver (shards x
bins rows at most); all nodes of a level are split together.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.plans.stored import stored

SHARDS = 40
BINS = 4096
TOLERANCE = 0.002
#: Bits of a coordinate: the value's, then the row's own.
VALUE_BITS, ROW_BITS = 31, 31
#: Rows of a shard are numbered in this many ranges of a hash.
SLOT_RANGES = 1024
OVERHEAD = 16

DIMENSIONS = ("d_size", "d_lang", "d_source", "d_text")


@dataclass
class _Node:
    """A part of the tree: the tests that lead to it, and its shards from ``first`` on."""

    tests: list[tuple[str, int, bool]]
    first: int
    shards: int

    def condition(self) -> Column:
        tests = [F.col(d) <= at if below else F.col(d) > at for d, at, below in self.tests]
        return reduce(lambda a, b: a & b, tests, F.lit(True))


def _number(nodes: list[_Node]) -> Column:
    """The node of a row, by descending the tree once."""
    def descend(group: list[tuple[int, _Node]], depth: int) -> Column:
        if len(group) == 1 and len(group[0][1].tests) <= depth:
            return F.lit(group[0][0])
        dimension, at, _ = group[0][1].tests[depth]
        low = [g for g in group if g[1].tests[depth][2]]
        high = [g for g in group if not g[1].tests[depth][2]]
        return F.when(F.col(dimension) <= at, descend(low, depth + 1)).otherwise(descend(high, depth + 1))
    return descend(list(enumerate(nodes)), 0)


def _prepared(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None, source_col: str | None) -> DataFrame:
    """Size, checksum and coordinates of each row; the text is read here only."""
    text = F.col(text_col)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD
    row = F.xxhash64(F.col(id_col), text)
    low = F.shiftrightunsigned(row, 64 - ROW_BITS)

    def place(value: Column) -> Column:
        return F.shiftleft(value, ROW_BITS).bitwiseOR(low)

    def hashed(name: str | None) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.col(name) if name else F.lit(0)), 64 - VALUE_BITS)

    return docs.select(
        F.col(id_col).alias("doc_id"), size.alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), row.alias("row"),
        place(size).alias("d_size"), place(hashed(lang_col)).alias("d_lang"), place(hashed(source_col)).alias("d_source"),
        place(F.shiftrightunsigned(F.crc32(F.coalesce(text, F.lit("")).cast("binary")), 1)).alias("d_text"))


def _split(rows: DataFrame, nodes: list[_Node], whole: dict[str, float]) -> list[_Node]:
    """All nodes of more than one shard, each split in two."""
    open_nodes = [n for n in nodes if n.shards > 1]
    placed = rows.withColumn("node", _number(nodes)).filter(F.col("node").isin(
        [i for i, n in enumerate(nodes) if n.shards > 1]))
    stats = {r.node: r for r in placed.groupBy("node").agg(
        F.sum("size").alias("bytes"), *[F.min(d).alias(f"low_{d}") for d in DIMENSIONS],
        *[F.max(d).alias(f"high_{d}") for d in DIMENSIONS]).collect()}
    number = {id(n): i for i, n in enumerate(nodes)}
    state = {}
    for n in open_nodes:
        left = n.shards // 2
        r = stats.get(number[id(n)])
        if r is None:
            state[id(n)] = (DIMENSIONS[0], 0, 0, 0, 0, left, 0)
            continue
        widest = max(DIMENSIONS, key=lambda d: (r[f"high_{d}"] - r[f"low_{d}"]) / max(1, whole[d]))
        state[id(n)] = (widest, r[f"low_{widest}"], r[f"high_{widest}"], 0, r.bytes * left / n.shards, left,
                        TOLERANCE * r.bytes / n.shards)
    live = {i for i, s in state.items() if s[2] > s[1]}
    while live:
        own = [n for n in open_nodes if id(n) in live]
        low = F.create_map(*[F.lit(x) for n in own for x in (number[id(n)], state[id(n)][1])])[F.col("node")]
        high = F.create_map(*[F.lit(x) for n in own for x in (number[id(n)], state[id(n)][2])])[F.col("node")]
        value = F.lit(None).cast("long")
        for d in {state[id(n)][0] for n in own}:
            value = F.when(F.col("node").isin([number[id(n)] for n in own if state[id(n)][0] == d]), F.col(d)).otherwise(value)
        counted = placed.filter(F.col("node").isin([number[id(n)] for n in own])).select(
            "node", "size", value.alias("v"), low.alias("low"), high.alias("high")).filter("v BETWEEN low AND high").select(
            "node", "size", F.expr(f"(v - low) DIV ((high - low) DIV {BINS} + 1)").alias("bin"))
        bins: dict[int, list[tuple[int, int]]] = {}
        for r in counted.groupBy("node", "bin").agg(F.sum("size").alias("bytes")).collect():
            bins.setdefault(r.node, []).append((r.bin, r.bytes))
        for n in own:
            dimension, a, b, before, goal, left, slack = state[id(n)]
            width = (b - a) // BINS + 1
            for k, held in sorted(bins.get(number[id(n)], [])):
                if before + held >= goal:
                    break
                before += held
            start, stop = a + k * width, min(b, a + (k + 1) * width - 1)
            if held <= slack or start == stop:
                # The side whose error is smaller takes the last bin.
                at = stop if goal - before >= before + held - goal else start - 1
                state[id(n)] = (dimension, at, at, before, goal, left, slack)
                live.discard(id(n))
            else:
                state[id(n)] = (dimension, start, stop, before, goal, left, slack)
    out = []
    for n in nodes:
        if n.shards == 1:
            out.append(n)
            continue
        dimension, at, _, _, _, left, _ = state[id(n)]
        out.append(_Node([*n.tests, (dimension, at, True)], n.first, left))
        out.append(_Node([*n.tests, (dimension, at, False)], n.first + left, n.shards - left))
    return out


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str | None = "lang", source_col: str | None = "source") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard`` and ``slot`` of each row.

    The law is ``bytes``: sizes of shards are near equal, a size being the text's UTF-8
    bytes (none for null) and 16.  ``slot`` counts the rows of a shard from 0 without gaps.
    Rows of one value in all dimensions are cut by a hash of id and text; whole repeats of
    a row cannot be cut and share a shard.  Null ids, languages and sources are values like
    others; other columns are left out; no rows give no rows.
    """
    rows = stored(_prepared(docs, id_col, text_col, lang_col, source_col), "metadata")
    ends = rows.agg(*[F.min(d).alias(f"low_{d}") for d in DIMENSIONS], *[F.max(d).alias(f"high_{d}") for d in DIMENSIONS]).first()
    whole = {d: (ends[f"high_{d}"] or 0) - (ends[f"low_{d}"] or 0) for d in DIMENSIONS}
    nodes = [_Node([], 0, shards)]
    while any(n.shards > 1 for n in nodes):
        nodes = _split(rows, nodes, whole)
    firsts = F.array(*[F.lit(n.first) for n in nodes])
    placed = rows.select("doc_id", "size", "text_crc32", "row", F.get(firsts, _number(nodes)).alias("shard")).withColumn(
        "part", F.expr(f"pmod(xxhash64(row, doc_id), {SLOT_RANGES})"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(
        Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "part").orderBy("row", "doc_id")
    return placed.join(offsets, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.row_number().over(inside) - 1).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
                 lang_col: str | None = "lang", source_col: str | None = "source") -> None:
    """Write ``docs`` with all columns to ``path``, a folder ``shard=N`` for each shard."""
    placed = shard(docs, shards, id_col, text_col, lang_col, source_col).select(
        F.col("doc_id").alias("__id"), F.col("text_crc32").alias("__crc"), "shard").distinct()
    joined = docs.join(placed, docs[id_col].eqNullSafe(placed["__id"])
                       & (F.crc32(F.coalesce(docs[text_col], F.lit("")).cast("binary")) == placed["__crc"]))
    joined.drop("__id", "__crc").write.partitionBy("shard").mode("overwrite").parquet(path)
