"""Stream sources, sinks and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwatch.operators.alerts import upsert_table
from fieldwatch.session import work_path


def stream_obs(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1, fmt: str = "parquet"
) -> DataFrame:
    """Observation files as a stream, some files per micro-batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def run_to_files(df: DataFrame, name: str) -> DataFrame:
    """Run a stream over all data there is, append to files, and return them as a table."""
    spark = df.sparkSession
    out = work_path(spark, name)
    query = (
        df.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", work_path(spark, f"{name}_checkpoint"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def alert_sink(df: DataFrame, path: str, checkpoint: str):
    """Upsert every micro-batch of log rows into the log.  A batch that is repeated after a
    failure changes nothing: the log knows which batches of this checkpoint it has."""

    def write(batch: DataFrame, number: int) -> None:
        upsert_table(batch.sparkSession, path, batch, f"{checkpoint}#{number}")

    return (
        df.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_arrivals(arrivals: list[DataFrame], job, name: str) -> DataFrame:
    """Run a stream job once per arrival of files, each time from its checkpoint, as a nightly
    run would; what it has appended to its sink in the end.

    job: the stream of arriving rows -> the stream to write.  An arrival is one micro-batch.
    """
    spark = arrivals[0].sparkSession
    source, out, checkpoint = (work_path(spark, f"{name}-{x}") for x in ("source", "out", "checkpoint"))
    for rows in arrivals:
        rows.write.mode("append").parquet(source)
        stream = job(spark.readStream.schema(rows.schema).parquet(source))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def observed_progress(df: DataFrame, name: str, flag: str = "qc_flag") -> tuple[DataFrame, DataFrame]:
    """Run a stream to its end; its sink, and its progress as the stream itself reports it.

    Rows and anomalies are counted by observed metrics while the rows pass, and read from
    each micro-batch's StreamingQueryProgress: batch, rows, anomalies, last_timestamp.
    Nothing is read again.
    """
    spark = df.sparkSession
    counted = df.observe(
        name,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(flag) != "PASSED").alias("anomalies"),
        F.max(F.col("timestamp").cast("string")).alias("last_timestamp"),
    )
    out = work_path(spark, name)
    query = counted.writeStream.format("parquet").option("path", out).option("checkpointLocation", work_path(spark, f"{name}_checkpoint"))
    query = query.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    seen = {}
    for p in query.recentProgress:  # a batch may report again when it finds nothing new
        metrics = p.observedMetrics.get(name)
        if metrics is not None and metrics["rows"]:
            seen[p.batchId] = (p.batchId, metrics["rows"], metrics["anomalies"], metrics["last_timestamp"])
    report = spark.createDataFrame(list(seen.values()), "batch long, rows long, anomalies long, last_timestamp string")
    report = report.withColumn("last_timestamp", F.col("last_timestamp").cast("timestamp_ntz"))
    return spark.read.schema(df.schema).parquet(out), report


def replay_progress(sink: DataFrame) -> DataFrame:
    """Processed rows, anomalies and last time per station, from what the stream has written."""
    return sink.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("qc_flag") != "PASSED").alias("anomalies"),
        F.max("timestamp").alias("last_timestamp"),
    )


def segments(rows: DataFrame, max_step_hours: float = 1.0, late: str | None = None) -> DataFrame:
    """Runs of rows of a station without a longer step: station_id, segment_start, segment_end, rows.

    Session windows: a row extends a session up to `max_step_hours` after its last row; the
    extra microsecond keeps a step of exactly that length inside.  On a stream, `late` is how
    far behind rows may come; a segment is given once the watermark has passed its end, and
    rows that come later than that are left out.
    """
    rows = rows.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    if late:
        rows = rows.withWatermark("timestamp", late)
    gap = f"{int(max_step_hours * 3_600_000_000) + 1} microseconds"
    found = rows.groupBy("station_id", F.session_window("timestamp", gap)).agg(F.count(F.lit(1)).alias("rows"), F.max("timestamp").alias("end"))
    return found.select(
        "station_id",
        F.col("session_window.start").cast("timestamp_ntz").alias("segment_start"),
        F.col("end").cast("timestamp_ntz").alias("segment_end"),
        "rows",
    )


def windowed_health(qc: DataFrame, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Rows per QC flag in event-time windows; with `late`, a stream drops rows later than that."""
    rows = qc.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    if late:
        rows = rows.withWatermark("timestamp", late)
    window = F.window("timestamp", width, slide) if slide else F.window("timestamp", width)
    return (
        rows.groupBy("station_id", window)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("qc_flag") == "SUSPECT").alias("suspect"),
            F.count_if(F.col("qc_flag") == "MISSING").alias("missing"),
        )
        .select(
            "station_id",
            F.col("window.start").cast("timestamp_ntz").alias("window_start"),
            "rows",
            "suspect",
            "missing",
        )
    )
