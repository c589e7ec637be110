"""Exact top-k search by inner product, term at a time.

Vectors become whole numbers, floor(scale * x).  Candidates lie in blocks of rows as posting
lists, for each dimension the rows that have it and their weights.  A block of queries
meets a block of candidates: each query term scatters weighted postings into dense score
arrays, the best k of the block are selected, and blocks are merged by a window on the
query.  Candidates are packed into blocks where they are read; one row per pair of blocks
is all that is joined, and a task holds one pair at a time.
"""

from __future__ import annotations

from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.batches import Batches, map_batches
from tickerloom.plans.stored import stored

SCALE = 256
K = 5
#: Queries of one block; a score array has one row per candidate and one column per query.
QUERY_BLOCK = 256
#: Sizes that 64 bits hold; components and scores beyond are refused.
LIMIT = 1 << 63


def _packed(scale: int, most: int, batches: Batches) -> Batches:
    """One row for each block of vectors: ids and a matrix of whole numbers, by length of the vectors."""
    numbers = count(TaskContext.get().partitionId() << 32)
    for batch in batches:
        ids, vectors = batch.column("id").to_numpy(), batch.column("vector").to_pylist()
        by_size: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by_size.setdefault(len(v), []).append(i)
        for size, all_rows in by_size.items():
            for a in range(0, len(all_rows), most):
                rows = all_rows[a: a + most]
                values = np.floor(np.array([vectors[i] for i in rows], np.float64).reshape(len(rows), size) * scale)
                largest = np.abs(values).max(initial=0)
                if largest >= LIMIT:
                    raise OverflowError(f"a component times {scale} does not fit 64 bits")
                matrix = values.astype("<i4" if largest < 1 << 31 else "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([next(numbers)]), pa.array([size]), pa.array([ids[rows].astype("<i8").tobytes()]),
                     pa.array([matrix.tobytes()])], ["block", "size", "ids", "matrix"])


_BLOCK = "block long, size long, ids binary, matrix binary"


def _scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """A row for each candidate, a column for each query; every term adds its postings."""
    total = np.zeros((len(candidates), len(queries)), np.int64)
    for term in range(candidates.shape[1]):
        asked = np.flatnonzero(queries[:, term])
        rows = np.flatnonzero(candidates[:, term])
        if not len(asked) or not len(rows):
            continue
        weights, postings = queries[asked, term], candidates[rows, term]
        if len(asked) == len(queries) and 2 * len(rows) > len(candidates):
            # A long list: the rows it lacks add zero.
            total += candidates[:, term, None] * weights
        else:
            total[np.ix_(rows, asked)] += postings[:, None] * weights
    return total


def _matrix(data: bytes, rows: int, size: int) -> np.ndarray:
    """A block's numbers, which have 4 bytes each if all fit."""
    return np.frombuffer(data, "<i4" if len(data) == 4 * rows * size else "<i8").reshape(rows, size).astype(np.int64)


def _exact(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """The scores of a block, in numbers of any size where 64 bits might not do."""
    if not len(queries) or not len(candidates):
        return _scores(queries, candidates)
    # Twice the bound, as doubles round it.
    bound = np.abs(queries.astype(np.float64)).max(axis=0) @ np.abs(candidates.astype(np.float64)).max(axis=0)
    if 2 * bound < LIMIT:
        return _scores(queries, candidates)
    total = candidates.astype(object) @ queries.T.astype(object)
    if any(abs(x) >= LIMIT for x in total.flat):
        raise OverflowError("a score does not fit 64 bits")
    return total.astype(np.int64)


def _best(k: int, batches: Batches) -> Batches:
    for batch in batches:
        found: list[tuple[int, int, int]] = []
        for row in batch.to_pylist():
            q_ids, c_ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
            total = _exact(_matrix(row["q_matrix"], len(q_ids), row["size"]),
                           _matrix(row["matrix"], len(c_ids), row["size"]))
            order = np.argsort(c_ids, kind="stable")
            ids, total = c_ids[order], total[order]
            first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            if len(first) < len(ids):
                ids, total = ids[first], np.maximum.reduceat(total, first, axis=0)
            if len(ids) > k + 1:
                least = np.partition(total, len(ids) - k - 1, axis=0)[len(ids) - k - 1]
            else:
                least = total.min(axis=0)
            for j, q in enumerate(q_ids.tolist()):
                near = np.flatnonzero((total[:, j] >= least[j]) & (ids != q))
                best = near[np.lexsort((ids[near], -total[near, j]))][:k]
                found += zip([q] * len(best), ids[best].tolist(), total[best, j].tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (zip(*found) if found else ((), (), ()))], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the best ``k`` rows for each query.

    Ties go to the smaller id.  A query never finds its own id.  Vectors without id, null,
    or holding null or a number that is not finite take no part; vectors of different
    lengths never meet; empty ones score 0 with one another.  Rows that share an id are one
    item: a query's best score with any of them counts, and so do queries that share one.
    Scores are exact; a component or score that 64 bits do not hold fails the query.
    Other columns are left out; no rows give no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"),
                          F.coalesce(is_query, F.lit(False)).alias("asked")).filter(
        "id IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))")
    candidates = stored(map_batches(rows.select("id", "vector"), partial(_packed, scale, 1 << 20), _BLOCK), "candidates")
    spark = vectors.sparkSession
    asked = rows.filter("asked").select("id", "vector")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    queries = map_batches(asked.repartition(blocks), partial(_packed, scale, QUERY_BLOCK), _BLOCK).select(
        "size", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    # Every block of candidates is listed by its number; each query block goes to all of them.
    listed = candidates.groupBy("size").agg(F.collect_list("block").alias("all_blocks"))
    dealt = queries.join(listed, "size").select("size", "q_ids", "q_matrix", F.explode("all_blocks").alias("block"))
    parts = max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = dealt.join(candidates.select("block", "ids", "matrix"), "block").repartition(parts)
    found = map_batches(pairs, partial(_best, k), "query_id long, vec_id long, score long")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
