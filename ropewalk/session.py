"""Session helpers: the shared scratch folder and lineage cuts that survive executor loss."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "ropewalk", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = sc.getCheckpointDir()
        if root is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            root = tempfile.mkdtemp(prefix="ropewalk-")
        spark.conf.set("spark.checkpoint.dir", root)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Materialize ``df`` as a table in the shared scratch folder and read it back.

    This cuts the lineage like a reliable checkpoint, but computes the plan once, keeps columns
    apart (later stages read only what they use), and gives the optimizer real sizes. The written
    files do not depend on any executor.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def few_rows_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it lasts, Python tasks of jobs that are started get at most ``rows`` rows at a time: for tables of large rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def listed_by_cores(spark: SparkSession) -> Iterator[None]:
    """While it lasts, folders of files that are opened are listed by a few tasks per core. Left to itself, Spark starts a task
    for every folder, up to 10,000 of them."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def sized_tasks(spark: SparkSession, rows: int, per_task: int = 250_000) -> Iterator[None]:
    """While it lasts, shuffles of jobs that are started are cut into tasks of about ``per_task`` of ``rows`` rows, at least one per
    core. Left to itself, AQE joins them into one per core up to 64 MB of packed bytes, so that a task's memory grows with
    the input."""
    want = {"spark.sql.shuffle.partitions": str(max(spark.sparkContext.defaultParallelism, -(-rows // per_task))),
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in want}
    try:
        for name, value in want.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
