"""A log table with atomic commits: data files that never change, and snapshots that list them.

path/data/commit=N/log_day=D/   rows of commit N, one file or a few per day
path/snapshots/version=N/       the entries that make up the log after commit N, one file

A commit writes its rows first and its snapshot last.  The snapshot is one file, which
Spark's writer moves into place when it is complete; until then, and for good if the
writer dies, readers see the log as it was.  A commit costs what its own rows cost: days
are not rewritten, a key's versions are merged when the log is read, and `compact` folds
days with many versions together.  Entries carry the range of times and ids of a day's
rows, so that reads open only the days they need.  One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = "log_day"
#: Versions of a day that are merged when it is read; with more, compaction folds them.
MOST_VERSIONS = 8
ENTRY = "commit long, day date, rows long, low timestamp_ntz, high timestamp_ntz, low_id long, high_id long, token string, schema string"
#: Bloom filters for look-ups, as large as a file's rows ask for.
WRITE = {
    "parquet.bloom.filter.enabled#id": "true",
    "parquet.bloom.filter.enabled#alert_key": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
}


def version(spark: SparkSession, path: str) -> int:
    """Number of the latest snapshot; -1 where there is no log."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*")
    try:
        found = files.load(f"{path}/snapshots").select(F.regexp_extract("path", r"version=(\d+)", 1).cast("long").alias("v"))
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing.getCondition()):
            raise
        return -1
    newest = found.agg(F.max("v")).first()[0]  # only names are read
    return -1 if newest is None else newest


def entries(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    """The snapshot's entries: one per commit and day, and a first one without a day that holds the schema."""
    at = version(spark, path) if at is None else at
    if at < 0:
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).parquet(f"{path}/snapshots/version={at:09d}")


def publish(spark: SparkSession, path: str, listed: DataFrame, number: int, schema: T.StructType, token: str | None = None) -> None:
    """Make `listed` the log's entries, in one step."""
    head = spark.createDataFrame([(number, None, 0, None, None, None, None, token, schema.json())], ENTRY)
    listed.where("day IS NOT NULL OR token IS NOT NULL").unionByName(head).coalesce(1).write.parquet(f"{path}/snapshots/version={number:09d}")


def _write(spark: SparkSession, path: str, rows: DataFrame, number: int) -> DataFrame:
    """Write a commit's rows; its entries.  What an attempt that died has left is replaced."""
    folder = f"{path}/data/commit={number:09d}"
    # Few files per day; adaptive execution splits a big day.
    rows.hint("rebalance", DAY).write.mode("overwrite").options(**WRITE).partitionBy(DAY).parquet(folder)
    back = spark.read.schema(rows.schema).parquet(folder)
    stats = back.groupBy(F.col(DAY).alias("day")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("timestamp").alias("low"),
        F.max("timestamp").alias("high"),
        F.min("id").alias("low_id"),
        F.max("id").alias("high_id"),
    )
    none = F.lit(None).cast("string")
    return stats.select(F.lit(number).cast("long").alias("commit"), *stats.columns, none.alias("token"), none.alias("schema"))


def append(spark: SparkSession, path: str, rows: DataFrame, token: str | None = None) -> bool:
    """Commit rows (with their day).  A token that was committed before is not committed again."""
    last = version(spark, path)
    known = entries(spark, path, last)
    if token is not None and not known.where(F.col("token") == token).isEmpty():
        return False
    added = _write(spark, path, rows, last + 1)
    publish(spark, path, known.unionByName(added), last + 1, rows.schema, token)
    return True


def schema_of(spark: SparkSession, path: str) -> T.StructType:
    newest = entries(spark, path).where("schema IS NOT NULL").orderBy(F.desc("commit")).select("schema").first()
    if newest is None:
        raise ValueError(f"no log at {path}")
    return T.StructType.fromJson(json.loads(newest["schema"]))


def days(listed: DataFrame) -> list[dict]:
    """Per day: its commits and the range of its times, the latest day first, undated ones last."""
    by_day = listed.where("day IS NOT NULL").groupBy("day").agg(F.max("high").alias("high"), F.sort_array(F.collect_list("commit")).alias("commits"))
    return [r.asDict() for r in by_day.orderBy(F.desc_nulls_last("high"), F.desc("day")).collect()]


def _read(spark: SparkSession, path: str, schema: T.StructType, chosen: list[dict]) -> DataFrame:
    """Rows of some days as written, with their commit."""
    full = T.StructType([*schema.fields, T.StructField("commit", T.LongType())])
    paths = [f"{path}/data/commit={c:09d}/{DAY}={d['day']}" for d in chosen for c in d["commits"]]
    if not paths:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", f"{path}/data").parquet(*paths)


def read(spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], chosen: list[dict] | None = None, where: Column | None = None) -> DataFrame:
    """The log, or some of its days.  merge: makes one row of a key's versions (`commit` tells their order).

    Days with one version need no merging.  where: a condition on what all versions of a row
    share (its key), so that it may go to the scan.
    """
    schema = schema_of(spark, path)
    chosen = days(entries(spark, path)) if chosen is None else chosen
    single = _read(spark, path, schema, [d for d in chosen if len(d["commits"]) == 1])
    several = _read(spark, path, schema, [d for d in chosen if len(d["commits"]) > 1])
    if where is not None:
        single, several = single.where(where), several.where(where)
    several = merge(several)
    return single.select(*schema.names).unionByName(several.select(*schema.names))


def compact(spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], most: int = MOST_VERSIONS) -> int:
    """Fold days that have more than `most` versions into one; how many days that were."""
    last = version(spark, path)
    known = entries(spark, path, last)
    full = [d for d in days(known) if len(d["commits"]) > most]
    if full:
        added = _write(spark, path, read(spark, path, merge, full), last + 1)
        folded = F.coalesce(F.col("day").isin([d["day"] for d in full]), F.lit(False))
        publish(spark, path, known.where(~folded).unionByName(added), last + 1, schema_of(spark, path))
    return len(full)


def clear(spark: SparkSession, path: str) -> None:
    """Commit an empty log."""
    last = version(spark, path)
    publish(spark, path, entries(spark, path, last).where("false"), last + 1, schema_of(spark, path))
