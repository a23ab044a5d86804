"""Session helpers: settings every job relies on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
METHOD_LIMIT_CONF = "spark.sql.codegen.hugeMethodLimit"


def build_session(app_name: str = "bestofk", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the package assumes (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Texts are costly per byte: let small shuffles keep more than one partition.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Call sites in error messages cost a stack walk per column call; plans here are wide.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder of the cluster's shared checkpoint folder.

    Tables written here are visible to every executor, so a lost executor only costs a
    re-read. Without the setting a folder is made up in local mode only; on a cluster a
    machine-local path would not be shared, so that is an error.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(CHECKPOINT_CONF, base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def compiled_by_operator(spark: SparkSession) -> Iterator[None]:
    """Within it, stages whose generated method is too long for the JVM to compile (8000 bytes) run operator by operator.

    Spark fuses neighbouring projections into one method. Beyond that length the JVM interprets it for good, at several times the cost.
    """
    before = spark.conf.get(METHOD_LIMIT_CONF, None)
    spark.conf.set(METHOD_LIMIT_CONF, "8000")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(METHOD_LIMIT_CONF)
        else:
            spark.conf.set(METHOD_LIMIT_CONF, before)


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a cut in the lineage."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use every core for rows that are about to multiply.

    Adaptive execution sizes partitions by their bytes, which says nothing about a step that turns
    each row into a thousand; an explicit partition count is kept as it is.
    """
    spark = df.sparkSession
    cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(cores, *keys)
