"""Largest cosine of each vector over a table of reference vectors, in blocks.

Vectors and references are packed into blocks of bounded size.  Blocks meet by a join on a
slice of the references; a pair of blocks is one matrix product, and the maximum over the
references of all slices is a partial aggregate.  Few references make one slice, which Spark
broadcasts by its own size threshold; many make many slices, and no task holds them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.plans.stored import stored

#: Vectors in a block, and blocks of references in a slice.
BLOCK_ROWS = 1024
SLICE_BLOCKS = 16


def reference_vectors(vectors: DataFrame, group: str, order: str, vector: str, k: int | None = None) -> DataFrame:
    """``reference``: the first vector of each group, of the ``k`` lowest groups where ``k`` is given."""
    firsts = vectors.groupBy(group).agg(F.min_by(vector, order).alias("reference"))
    return (firsts if k is None else firsts.orderBy(group).limit(k)).select("reference")


def _packer(rows: int):
    """Batches of ``vector`` (and ``id``) as blocks of unit vectors of one size; without a direction they are zeros."""
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes = frame["vector"].map(len)
            for size, part in frame.groupby(sizes):
                for start in range(0, len(part), rows):
                    some = part.iloc[start:start + rows]
                    matrix = np.array([np.asarray(v, float) for v in some["vector"]]).reshape(len(some), size)
                    norms = np.sqrt((matrix * matrix).sum(axis=1))
                    known = np.isfinite(norms) & (norms > 0)
                    unit = np.where(known[:, None], matrix, 0.0) / np.where(known, norms, 1.0)[:, None]
                    yield pd.DataFrame({"size": [size], "ids": [some["id"].to_numpy()], "data": [unit.tobytes()]})
    return pack


def _blocks(df: DataFrame, rows: int) -> DataFrame:
    kind = df.schema["id"].dataType.simpleString()
    return df.mapInPandas(_packer(rows), f"size int, ids array<{kind}>, data binary")


def _products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for size, ids, data, references in zip(frame["size"], frame["ids"], frame["data"], frame["references"]):
            own = np.frombuffer(data).reshape(len(ids), size)
            best = (own @ np.frombuffer(references).reshape(-1, size).T).max(axis=1)
            yield pd.DataFrame({"id": ids, "score": best})


def best_cosine(vectors: DataFrame, references: DataFrame, id_col: str = "vec_id", vector: str = "embedding",
                reference: str = "reference", digits: int = 4, block_rows: int = BLOCK_ROWS,
                slice_blocks: int = SLICE_BLOCKS) -> DataFrame:
    """``id`` and ``score``, the largest cosine of a row's vector over all references, rounded.

    Rows without id or vector, and vectors of a size that no reference has, give no row.  A
    vector of zeros, or with a component that is null or not finite, scores 0.  References
    that are null, zero or hold such components count for nothing.  Rows that repeat an id
    share the best score.  Without references, or without vectors, the result is empty.
    """
    shown = F.transform(F.col(reference), lambda x: x.cast("double"))
    square = F.aggregate(shown, F.lit(0.0), lambda acc, x: acc + x * x)
    usable = references.select(F.lit(0).alias("id"), shown.alias("vector"), square.alias("square")).filter(
        "square > 0 AND square < double('Infinity')").select("id", "vector")
    packed = stored(_blocks(usable, block_rows).select(
        "size", F.col("data").alias("references"), F.monotonically_increasing_id().alias("block")), "references")
    # One number comes to the driver; blocks of a slice are a bounded number up to the evenness of a hash.
    slices = max(1, -(-packed.count() // slice_blocks))
    dealt = packed.select("size", "references", F.pmod(F.xxhash64("block"), F.lit(slices)).alias("slice"))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(id_col).alias("id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("vector"))
    own = _blocks(rows, block_rows).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"))
    pairs = own.join(dealt, ["size", "slice"]).select("size", "ids", "data", "references")
    kind = vectors.schema[id_col].dataType.simpleString()
    scores = pairs.mapInPandas(_products, f"id {kind}, score double")
    return scores.groupBy("id").agg(F.round(F.max("score"), digits).alias("score"))
