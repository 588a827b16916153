"""Reading and writing observation tables."""

from __future__ import annotations

import hashlib
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwatch.config import DAY_FIRST_FORMATS, RAW_COLUMNS
from fieldwatch.operators.cleaning import parse_timestamp, to_number

RAW_SCHEMA = T.StructType(
    [T.StructField(RAW_COLUMNS[0], T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in RAW_COLUMNS[1:]]
)


def read_obs_csv(
    spark: SparkSession, path: str, nrows: int | None = None, schema: T.StructType = RAW_SCHEMA
) -> DataFrame:
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df if nrows is None else df.limit(nrows)


def write_obs_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def read_obs_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_clean_parquet(df: DataFrame, path: str, day: str = "day") -> None:
    """Snappy Parquet, one folder per day, sorted by station inside a file.

    Days are rebalanced before writing: adaptive execution joins small days' rows and
    splits a big day, so files follow the volume, not the number of stations.
    """
    spread = df.withColumn(day, F.to_date("timestamp")).hint("rebalance", day)
    spread.sortWithinPartitions(day, "station_id", "timestamp").write.option("compression", "snappy").partitionBy(day).parquet(path)


def write_report_json(report: DataFrame, path: str) -> None:
    """One JSON object per report row (reports hold one row per station)."""
    report.write.json(path)


#: Bytes of a file that are held at once.
CHUNK = 4 << 20


def _file(path: str):
    """The file system a file lies in, and its name there."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def file_digest(path: str, chunk: int = CHUNK) -> str:
    """SHA-256 of a file, read in pieces of bounded size."""
    digest = hashlib.sha256()
    system, name = _file(path)
    with system.open_input_stream(name) as stream:
        while piece := stream.read(chunk):
            digest.update(piece)
    return digest.hexdigest()


def source_manifest(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """Checksum, size and modification time of every file under `path`, of any size.

    Spark's reader lists the files (names only, empty files too).  They are dealt out over
    the cluster, and a task reads each of its files piece by piece into one running
    digest, so it holds `chunk` bytes, never a file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).inputFiles()
    listed = spark.createDataFrame([(unquote(f),) for f in files], "path string").repartition(max(1, len(files)))

    def digests(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, name = _file(path)
                info = system.get_file_info(name)
                row = {"path": path, "sha256": file_digest(path, chunk), "size": info.size, "modified": info.mtime}
                yield pa.RecordBatch.from_pylist([row], MANIFEST)

    return listed.mapInArrow(digests, "path string, sha256 string, size long, modified timestamp")


MANIFEST = pa.schema([("path", pa.string()), ("sha256", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC"))])


def compare_manifests(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that were added, removed or changed between two manifests."""
    a, b = before.alias("a"), after.alias("b")
    status = (
        F.when(F.col("a.path").isNull(), "added")
        .when(F.col("b.path").isNull(), "removed")
        .when(F.col("a.sha256") != F.col("b.sha256"), "changed")
        .otherwise("same")
    )
    return a.join(b, F.col("a.path") == F.col("b.path"), "full_outer").select(
        F.coalesce("a.path", "b.path").alias("path"), status.alias("status")
    )


def ingest_external(df: DataFrame) -> DataFrame:
    """Another network's layout: obstime, tempr, ap, rh; day-first times, numbers as text."""
    named = df.withColumnsRenamed(
        {"obstime": "timestamp", "tempr": "temperature", "ap": "pressure", "rh": "humidity"}
    )
    numbers = {c: to_number(F.col(c)) for c in ("temperature", "pressure", "humidity")}
    return named.withColumn(
        "timestamp", parse_timestamp(F.col("timestamp"), DAY_FIRST_FORMATS)
    ).withColumns(numbers)


def external_audit(df: DataFrame) -> DataFrame:
    """Counts for an ingested external table, per station."""
    distinct = df.groupBy("station_id", "timestamp").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(c).alias(f"n_{c}") for c in ("temperature", "pressure", "humidity")],
    )
    n = F.col("n")
    return distinct.groupBy("station_id").agg(
        F.sum(n).alias("rows"),
        F.min("timestamp").alias("date_start"),
        F.max("timestamp").alias("date_end"),
        F.sum(F.when(F.col("timestamp").isNull(), n).otherwise(0)).alias("invalid_timestamps"),
        *[
            F.sum(n - F.col(f"n_{c}")).alias(f"{c}_missing")
            for c in ("temperature", "pressure", "humidity")
        ],
        F.sum(n - 1).alias("duplicate_timestamps"),
    )


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def find_station(stations: DataFrame, station_id: str) -> DataFrame:
    """Case-insensitive lookup by id."""
    return stations.where(F.lower("station_id") == station_id.lower())
