"""Arrow batches of bounded size, and rows in and out of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tickerloom.session import ship_package

#: Rows of one Arrow batch; a batch of texts holds this many whole texts.
BATCH_ROWS = 1000

Batches = Iterator[pa.RecordBatch]


def map_batches(df: DataFrame, run: Callable[[Batches], Batches], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over batches of at most ``BATCH_ROWS`` rows."""
    spark = df.sparkSession
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """Texts of a column, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def sorted_groups(batches: Batches, keys: list[str]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Whole groups of rows with equal keys, from batches sorted by them.

    Yields a table and the ranges of the groups in it; a group is never split.  Keys are
    whole numbers without nulls.
    """
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        change = np.zeros(table.num_rows, bool)
        change[0] = True
        for key in keys:
            values = table.column(key).to_numpy()
            change[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(change).tolist()
        if len(starts) > 1:
            yield table.slice(0, starts[-1]).combine_chunks(), list(zip(starts, starts[1:]))
        rest = table.slice(starts[-1])
    if rest is not None:
        yield rest.combine_chunks(), [(0, rest.num_rows)]
