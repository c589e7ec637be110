"""Positions, prefix sums and bounded row blocks for ordered data.

A window over a whole key group puts that group into one task.  A single
symbol or ticker may own a third of all rows, so the operators of this package
number rows in two levels instead:

1. a *bucket* (a time span; a score, then a range of ids) that grows with the
   wanted order is counted per key with a map-side partial aggregate;
2. running sums over the few buckets of each level give each bucket's offset;
3. rows are numbered inside (key, bucket) only.

With exact positions at hand, a series is cut into blocks of a fixed number of
rows.  Each block also receives the last rows of the block before it (its
*halo*), so a sliding frame never has to look outside its own task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(left: DataFrame, right: DataFrame, names: Sequence[str], null_safe: bool) -> Column:
    tests = [
        left[n].eqNullSafe(right[f"_k_{n}"]) if null_safe else left[n] == right[f"_k_{n}"]
        for n in names
    ]
    return reduce(lambda a, b: a & b, tests)


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    buckets: Sequence[str],
    bucket_order: Sequence[Column],
    row_order: Sequence[Column],
    name: str = "idx",
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, tuple[str, str]] | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Add the 0-based position of each row within ``keys``.

    ``buckets`` are nested levels, each ordered by its entry of ``bucket_order``;
    ``row_order`` must refine them.  A level is summed up within the level above it
    only, so no window sees more rows than one level has values.  ``sums`` adds
    inclusive running sums; ``lasts`` (one level only) maps a new column to
    ``(value, order)`` and adds the value of the previous row.
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    if lasts and len(buckets) > 1:
        raise ValueError("previous values need a single bucket level")
    by = [*keys, *buckets]
    totals = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(expr).alias(f"_s_{out}") for out, expr in sums.items()],
        *[F.max_by(value, order).alias(f"_l_{out}") for out, (value, order) in lasts.items()],
    )
    measures = ["_n", *[f"_s_{out}" for out in sums]]
    offsets = None
    for depth in range(len(buckets), 0, -1):
        above, level = [*keys, *buckets[: depth - 1]], [*keys, *buckets[:depth]]
        rows = totals if depth == len(buckets) else totals.groupBy(*level).agg(*[F.sum(m).alias(m) for m in measures])
        across = Window.partitionBy(*above).orderBy(bucket_order[depth - 1])
        before = across.rowsBetween(Window.unboundedPreceding, -1)
        part = rows.select(
            *[F.col(n).alias(f"_k_{n}" if depth == len(buckets) else f"_u_{n}") for n in level],
            *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"{m}_{depth}") for m in measures],
            *[F.lag(f"_l_{o}").over(across).alias(f"_p_{o}") for o in lasts],
        )
        if offsets is None:
            offsets = part
            continue
        tests = [F.col(f"_k_{n}").eqNullSafe(F.col(f"_u_{n}")) if null_safe else F.col(f"_k_{n}") == F.col(f"_u_{n}")
                 for n in level]
        offsets = offsets.join(part, reduce(lambda a, b: a & b, tests)).drop(*[f"_u_{n}" for n in level])
    start = {m: reduce(lambda a, b: a + b, [F.col(f"{m}_{d}") for d in range(1, len(buckets) + 1)]) for m in measures}

    inside = Window.partitionBy(*by).orderBy(*row_order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(offsets, _same(df, offsets, by, null_safe))
    return joined.select(
        *[df[c] for c in df.columns],
        (start["_n"] + F.row_number().over(inside) - 1).alias(name),
        *[(start[f"_s_{o}"] + F.sum(e).over(upto)).alias(o) for o, e in sums.items()],
        *[
            F.coalesce(F.lag(value).over(inside), F.col(f"_p_{o}")).alias(o)
            for o, (value, _) in lasts.items()
        ],
    )


def with_halo(df: DataFrame, rows: int, halo: int, idx: str = "idx") -> DataFrame:
    """Assign rows to ``block`` and copy each block's last ``halo`` rows to the next one.

    ``owned`` is false on the copies; drop them after the windowed work.
    """
    if not 0 <= halo < rows:
        raise ValueError("halo must be smaller than a block")
    own = F.floor(F.col(idx) / rows)
    tail = F.col(idx) % rows >= rows - halo
    blocks = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own)) if halo else F.array(own)
    return df.select("*", F.explode(blocks).alias("block")).withColumn("owned", own == F.col("block"))
