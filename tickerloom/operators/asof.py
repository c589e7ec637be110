"""As-of join: the last earlier row of each key, for many points in time.

Both sides are dealt together by range of (key, time), so a key with many rows lies in many
stretches and no task holds it.  Inside a stretch the last value is carried forward by a
window over (key, stretch).  What a stretch hands on, its last value of each key, is a small
table; carried across the stretches of a key, it serves the rows before the first value of
their stretch.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.plans.stored import stored


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
               values: Sequence[str], strict: bool = False, stretches: int | None = None) -> DataFrame:
    """``left`` with ``right_time`` and ``values`` of the last row of ``right`` not after ``left_time``.

    ``strict`` looks before ``left_time`` only.  A left row without a match gets nulls, as
    does one without a time; right rows without a time match nothing.  Null keys match null
    keys.  Of right rows of one time the one with the greatest values, column by column,
    counts.  Left rows that repeat all stay.
    """
    parts = stretches or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    clash = [c for c in (right_time, *values) if c in left.columns]
    if clash:
        raise ValueError(f"columns of both sides: {clash}")
    by = [f"_k{i}" for i in range(len(keys))]
    asked = left.select(*[F.col(f"`{k}`").alias(b) for k, b in zip(keys, by)], F.col(f"`{left_time}`").alias("_at"),
                        F.lit(0 if strict else 1).alias("_side"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_left"))
    found = right.filter(F.col(f"`{right_time}`").isNotNull()).select(
        *[F.col(f"`{k}`").alias(b) for k, b in zip(keys, by)], F.col(f"`{right_time}`").alias("_at"),
        F.lit(1 if strict else 0).alias("_side"),
        F.struct(F.col(f"`{right_time}`"), *[F.col(f"`{v}`") for v in values]).alias("_right"))
    order = ["_at", "_side", "_right"]
    rows = asked.unionByName(found, allowMissingColumns=True)
    dealt = stored(rows.repartitionByRange(parts, *by, *order).withColumn("_stretch", F.spark_partition_id()), "as_of")

    ends = dealt.filter(F.col("_right").isNotNull()).groupBy(*by, "_stretch").agg(F.max("_right").alias("_end"))
    # At most one row per stretch of a key.
    before = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    places = dealt.select(*by, "_stretch").distinct().join(*_on(ends, [*by, "_stretch"]))
    carried = places.select(*by, "_stretch", F.last("_end", ignorenulls=True).over(before).alias("_carried")).filter(
        F.col("_carried").isNotNull())
    inside = Window.partitionBy(*by, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = dealt.withColumn("_own", F.last("_right", ignorenulls=True).over(inside)).filter(F.col("_left").isNotNull())
    joined = last.join(*_on(carried, [*by, "_stretch"]))
    match = F.when(F.col("_at").isNotNull(), F.coalesce("_own", "_carried"))
    return joined.select("_left.*", match.alias("_match")).select(*[F.col(f"`{c}`") for c in left.columns], "_match.*")


def _on(other: DataFrame, names: Sequence[str]):
    """Arguments of a left join on equal names, null keys included; the other side's names go."""
    renamed = other.withColumnsRenamed({n: f"_o{n}" for n in names})
    tests = [F.col(n).eqNullSafe(F.col(f"_o{n}")) for n in names]
    return renamed, reduce(lambda a, b: a & b, tests), "left"
