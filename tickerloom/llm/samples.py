"""Samples of bounded size for fitting, chosen by a hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sampled(rows: DataFrame, by: str, draw: str, most: int) -> DataFrame:
    """About ``most`` rows of each value of ``by``, or all where a value has no more than that.

    ``draw`` is a column of 64-bit hashes; a row is taken if its hash lies in the share of all
    hashes that leaves ``most`` rows on average.  Nothing is ranked and no rows move: only
    counts are shuffled, and one row for each value of ``by`` is broadcast, so ``by`` must be a
    column of few values (labels, languages).  Rows where ``by`` is null are left out; rows of
    equal hash are taken or left together; no rows give no rows.
    """
    sizes = rows.groupBy(by).agg(F.count("*").alias("_rows"))
    place = F.col(draw) / F.lit(2.0 ** 64) + 0.5
    return rows.join(F.broadcast(sizes), by).filter(place * F.col("_rows") < most).drop("_rows")
