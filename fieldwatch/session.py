"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

BLOCK_ROWS = "spark.fieldwatch.block.rows"
BLOCK_BUCKET = "spark.fieldwatch.block.bucket"


def conf(spark: SparkSession, key: str, default: str) -> str:
    """Session setting, else the value the application was submitted with, else default."""
    value = spark.conf.get(key, None)
    if value is None:
        value = spark.sparkContext.getConf().get(key, None)
    return default if value is None else value


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder all executors share (spark.checkpoint.dir).

    Only a local master may fall back to the machine's temporary folder.
    """
    base = conf(spark, "spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = os.path.join(tempfile.gettempdir(), "fieldwatch-work")
    return f"{base.rstrip('/')}/fieldwatch/{uuid.uuid4().hex}/{name}"


def cut(df, name: str = "cut"):
    """Write a frame to the shared folder and read it back, so that later steps
    start from stored rows, not from the whole lineage."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_sized(df):
    """Marks a side of a join that grows with the rows, so that both sides are shuffled and merged.

    Series compress so well, in stored tables and in shuffles, that Spark's size check takes
    millions of rows for a small table; it would collect them on the driver and send them
    to every executor.
    """
    return df.hint("merge")


def local_session(cpus: int | str = "*", partitions: int = 8, **extra) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster use your own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fieldwatch")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    builder = builder.config("spark.python.sql.dataFrameDebugging.enabled", "false")
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()
