"""Written intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tickerloom.session import shared_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a derived table is read several times, or where an iterative job
    must be able to go on after losing executors.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

