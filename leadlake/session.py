"""Session helpers: recommended settings, the shared scratch folder, written intermediates."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# AQE splits skewed join partitions; "force" keeps doing so when a later
# operator would otherwise have reused the join's partitioning.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
# Set where the session leaves Spark's default. Shuffle partitions are joined up to this size; what a task sorts and hashes is many times
# as large as what it reads compressed, so this bounds its memory as tables grow. Rows go to Python in batches up to the second size: a batch is
# there several times at once (in the JVM, in the worker, as Python objects), and by rows alone it grows with the texts.
DEFAULT_SETTINGS = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
# Rows of one partition that ``spread`` makes.
SPREAD_ROWS = 500_000


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time SQL settings the operators are planned for, and ship the package to the executors."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    for key, value in DEFAULT_SETTINGS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which need not have it installed. Done once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    staging = tempfile.mkdtemp(prefix="leadlake-package-")
    source = shutil.copytree(package, os.path.join(staging, "source", package.name), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(os.path.join(staging, package.name), "zip", os.path.dirname(source)))
    _shipped.add(context.applicationId)


def build_session(app: str = "leadlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session for local use and tests; a cluster passes its own."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


_fallback_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only a local master, where driver and executors are one process, may leave both unset; a
    temporary folder is used then. Elsewhere executors would write to disks of their own.
    """
    global _fallback_dir
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _fallback_dir is None:
        _fallback_dir = tempfile.mkdtemp(prefix="leadlake-")
    return _fallback_dir


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage, survives lost executors, and gives the planner real sizes, so a
    later broadcast is chosen only when the written table is small enough.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(table: DataFrame) -> DataFrame:
    """Deal the rows of a table to all cores ahead of heavy per-row work.

    Costs a shuffle, and a count, which reads no columns. A large table gets more partitions than there are cores, so that tasks do not grow with it;
    a stream is dealt to the cores.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores if table.isStreaming else max(cores, -(-table.count() // SPREAD_ROWS)))
