"""Linear recurrences ``e[i] = a * e[i-1] + k * x[i]`` without a sequential pass.

Exponential and Wilder averages are affine maps, so a stretch of rows folds into
one number: its own contribution at its last row.  That fold is a plain sum with
weights ``a**distance`` and runs as a partial aggregate.  The value entering a
block is then a short sum over the preceding stretches, and inside a block a
running sum with weights ``a**-position`` finishes the work.  Every task sees one
bounded block, whatever the length of a series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

# Powers of ten a double can lose or gain before it leaves its range.
_SAFE_GROWTH = 250.0
_VANISHED = 330.0


@dataclass(frozen=True)
class Recurrence:
    """``k``-weighted average of column ``x``, seeded by the mean of ``seed`` rows.

    ``first`` is the position of the first usable input row; the first result is
    at ``first + seed - 1``.
    """

    name: str
    x: str
    k: float
    seed: int
    first: int = 0

    @property
    def a(self) -> float:
        return 1.0 - self.k

    @property
    def start(self) -> int:
        return self.first + self.seed - 1

    @property
    def digits(self) -> float:
        """Decimal digits by which a value shrinks per row."""
        return math.inf if self.a <= 0 else -math.log10(self.a)


def ema(name: str, x: str, period: int, first: int = 0, seed: str = "sma") -> Recurrence:
    return Recurrence(name, x, 2.0 / (period + 1), period if seed == "sma" else 1, first)


def wilder(name: str, x: str, period: int, first: int = 1, seed: str = "sma") -> Recurrence:
    return Recurrence(name, x, 1.0 / period, period if seed == "sma" else 1, first)


def block_rows(recurrences: Sequence[Recurrence], halo: int, wanted: int = 2048) -> int:
    """Largest block, of ``wanted`` rows or as many as the seeds need, that keeps all weights inside a double."""
    need = max([halo, *[halo + r.start + 1 for r in recurrences]]) + 1
    rows = max(wanted, need)
    for r in recurrences:
        if r.digits < math.inf:
            rows = min(rows, int(_SAFE_GROWTH / r.digits) - halo)
    if rows < need:
        raise ValueError("periods too far apart for one pass")
    return rows


def passes(recurrences: Sequence[Recurrence], halo: int, wanted: int = 2048,
           beside: Sequence[Recurrence] = ()) -> list[list[Recurrence]]:
    """Recurrences in groups that share a block size; the first group's blocks have the halo, the others' none.

    Blocks of the first group also suit the recurrences ``beside`` it.

    Fast ones allow short blocks only, slow ones need long blocks for their seed.  Taken from slow to
    fast, each joins the first group it fits.  One alone always fits blocks without a halo.
    """
    groups: list[list[Recurrence]] = [[]]
    for r in sorted(recurrences, key=lambda r: r.digits):
        for i, group in enumerate(groups):
            try:
                block_rows([*group, r, *(() if i else beside)], 0 if i else halo, wanted)
            except ValueError:
                continue
            group.append(r)
            break
        else:
            groups.append([r])
    return groups


def run(df: DataFrame, keys: Sequence[str], recurrences: Sequence[Recurrence], wanted: int = 2048) -> DataFrame:
    """``keys``, ``idx`` and the results of recurrences that share a block size, in a pass of their own."""
    from tickerloom.plans.blocks import with_halo

    rows = block_rows(recurrences, 0, wanted)
    narrow = df.select(*keys, "idx", *dict.fromkeys(r.x for r in recurrences))
    blocks = with_halo(narrow, rows, 0).join(block_carries(narrow, keys, recurrences, rows, 0), [*keys, "block"])
    w = Window.partitionBy(*keys, "block").orderBy("idx")
    return blocks.select(*keys, "idx", *[scan(r, w, rows, 0).alias(r.name) for r in recurrences])


def _fold(parts: Column, step: float) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda acc, part: acc * step + part)


def block_carries(df: DataFrame, keys: Sequence[str], recurrences: Sequence[Recurrence],
                  rows: int, halo: int) -> DataFrame:
    """One row per (keys, block): each recurrence's value just before the block's halo."""
    idx = F.col("idx")
    stretch = F.floor((idx + halo) / rows)
    end = (F.col("block") + 1) * rows - halo - 1
    sums = []
    for r in recurrences:
        weight = F.when(idx <= r.start, F.pow(F.lit(r.a), end - r.start) / r.seed).otherwise(
            F.pow(F.lit(r.a), end - idx) * r.k
        )
        usable = (idx >= r.first) & (idx <= end)
        sums.append(F.sum(F.when(usable, F.col(r.x) * weight)).alias(f"_c_{r.name}"))
    parts = df.withColumn("block", stretch).groupBy(*keys, "block").agg(*sums)

    across = Window.partitionBy(*keys).orderBy("block")
    carried = []
    for r in recurrences:
        step = r.a**rows
        reach = max(1, math.ceil(_VANISHED / (r.digits * rows))) if r.digits < math.inf else 1
        earlier = F.collect_list(F.coalesce(f"_c_{r.name}", F.lit(0.0))).over(
            across.rowsBetween(-reach, -1)
        )
        carried.append(_fold(earlier, step).alias(f"_c_{r.name}"))
    return parts.select(*keys, "block", *carried)


def scan(r: Recurrence, window: WindowSpec, rows: int, halo: int, carried: bool = True) -> Column:
    """Value of ``r`` on every row of a block; null before its seed row.

    ``carried`` false starts at the block's halo without an incoming value, for
    inputs that are themselves results of the pass.  The halo must then be long
    enough for ``a**halo`` to fall below a double's resolution.
    """
    idx = F.col("idx")
    begin = F.greatest(F.col("block") * rows - halo, F.lit(0))
    pos = idx - begin
    x = F.coalesce(F.col(r.x), F.lit(0.0))
    if r.a <= 0:
        return F.when(idx >= r.start, x)
    grow = F.lit(1.0 / r.a)
    term = (
        F.when(idx < r.first, F.lit(0.0))
        .when(idx <= r.start, x * F.pow(grow, F.lit(r.start) - begin) / r.seed)
        .otherwise(x * F.pow(grow, pos) * r.k)
    )
    total = F.sum(term).over(window.rowsBetween(Window.unboundedPreceding, 0))
    value = total * F.pow(F.lit(r.a), pos)
    if carried:
        value = value + F.coalesce(F.col(f"_c_{r.name}"), F.lit(0.0)) * F.pow(F.lit(r.a), pos + 1)
    return F.when(idx >= r.start, value)
