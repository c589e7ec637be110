"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.plans.stored import stored


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _signature(edges: DataFrame) -> tuple[int, int]:
    n, total = edges.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return n, total or 0


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, its smallest reachable node, from edges (``u``, ``v``) of longs.

    Large-star and small-star rounds: nodes hook onto the smallest node among their
    neighbours until every component is a star.  The number of rounds grows with the
    logarithm of the longest path.  Each round is written to the shared folder.  Only
    nodes with edges are returned; no edges give no rows.
    """
    edges = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                   .distinct(), "edges")
    seen = _signature(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hub = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(hub, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large_star")
        small = large.join(_least(large), "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
            .alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges = stored(small, "small_star")
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
