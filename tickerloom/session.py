"""Session settings and the shared folder for durable intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Window passes cost far more time than bytes; do not merge them into few tasks.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128KB",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even when the split costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tickerloom", master: str | None = None,
                  shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once for a context; functions are pickled by name."""
    context = spark.sparkContext
    if getattr(context, "_tickerloom_shipped", False):
        return
    # Spark serves the archive from the driver for as long as the application runs.
    folder = tempfile.mkdtemp(prefix="tickerloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    package = Path(__file__).parent
    copy = Path(folder, "src", package.name)
    shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(Path(folder, package.name)), "zip", copy.parent))
    context._tickerloom_shipped = True


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for one job's intermediate tables.

    It lies under ``spark.checkpoint.dir``, which a cluster points at storage
    every executor can reach.  Only a session without that setting, such as a
    local test, gets a temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="tickerloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")
