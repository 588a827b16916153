"""Queries: streams, run to the end of the given data and compared with the batch rules."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldwatch.config import CHANNELS
from fieldwatch.operators.qc import quality_control
from fieldwatch.plans import q_alerts
from fieldwatch.operators import alerts
from fieldwatch.plans.catalog import Catalog
from fieldwatch.plans.driver_views import HOLED, clean_sparse, holed
from fieldwatch.plans.q_features import WINDOW_OUT, window_sums, windows_sql
from fieldwatch.plans.q_health import LONG, QC
from fieldwatch.plans.q_qc import flat_text
from fieldwatch.plans.sqltext import QC_COLUMNS, SPARSE, service_ctes, sql, steps
from fieldwatch.session import cut, work_path
from fieldwatch.streaming import jobs, state

cat = Catalog()
KEYS = ["station_id", "timestamp"]


def arriving(df, parts=4):
    """The rows as files that arrive in time order, `parts` micro-batches."""
    spark = df.sparkSession
    path = work_path(spark, "arriving")
    df.repartitionByRange(parts, "timestamp").sortWithinPartitions("timestamp").write.parquet(path)
    return jobs.stream_obs(spark, path, df.schema)


def in_order(df):
    """As `arriving`, one time window after the other, each station of a window in one file, so
    that no micro-batch holds an earlier row of a station.

    A micro-batch is a whole window that has rows, and takes a fixed number of files.  Each core
    writes one file for each window: besides its stations' rows, if any, it holds a row that the
    stream leaves out.  So the number of micro-batches grows neither with the rows nor with the
    cores.  The rows are stored first, as they are read once for each window.
    """
    spark, df = df.sparkSession, cut(df, "in-order")
    path, parts = work_path(spark, "arriving"), spark.sparkContext.defaultParallelism
    begun = [F.col("timestamp") >= day for day in ("2024-01-09", "2024-01-17", "2024-01-25")]
    windows = [~begun[0], begun[0] & ~begun[1], begun[1] & ~begun[2], begun[2]]
    rows = df.agg(*[F.count_if(w) for w in windows]).first()
    windows = [w for w, n in zip(windows, rows) if n] or windows[:1]
    blank = spark.range(parts).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema], F.lit(False).alias("_row"), F.col("id").cast("int").alias("_file"))
    dealt = df.withColumns({"_row": F.lit(True), "_file": F.pmod(F.hash("station_id"), F.lit(parts))})
    for window in windows:
        files = dealt.where(window).union(blank).repartitionById(parts, "_file").drop("_file")
        files.write.mode("append").option("maxRecordsPerFile", 0).parquet(path)
    return jobs.stream_obs(spark, path, files.schema, parts).where("_row").drop("_row")


@cat.query(sql(SPARSE, body='SELECT station_id, "timestamp", temperature, pressure, humidity FROM sparse'))
def stream_obs(spark, d):
    return jobs.run_to_files(arriving(clean_sparse(spark, d).select(*KEYS, *CHANNELS)), "obs")


def qc_stream(spark, d):
    state.use_rocksdb(spark)
    rows = in_order(clean_sparse(spark, d).select(*KEYS, *CHANNELS))
    return jobs.run_to_files(state.stream_qc(rows), "qc")


@cat.query(sql(*service_ctes("sparse"), body=f"SELECT {QC_COLUMNS} FROM qc"))
def stream_qc(spark, d):
    """Runs of equal readings do not occur in this view, so stream and batch agree fully."""
    return flat_text(qc_stream(spark, d))


@cat.query(
    sql(
        *QC,
        LONG,
        body="""SELECT station_id, "timestamp", parameter, round(e24, 6) AS error_rate_24h, round(noise_variance, 6) AS noise_variance,
  round(cusum_drift, 6) + 0 AS cusum_drift, flat_run AS consecutive_flatlines, round(health_index, 6) AS health_index, status FROM hh""",
    )
)
def stream_health(spark, d):
    state.use_rocksdb(spark)
    out = jobs.run_to_files(state.stream_health(in_order(quality_control(holed(spark, d)))), "health")
    nums = ["error_rate_24h", "noise_variance", "cusum_drift", "health_index"]
    return out.select(*KEYS, "parameter", "consecutive_flatlines", "status", *[F.round(n, 6).alias(n) for n in nums])


@cat.query(sql(HOLED, steps("holed", "src0"), windows_sql("h > 1.5"), body=WINDOW_OUT))
def stream_sequence_24(spark, d):
    state.use_rocksdb(spark)
    out = jobs.run_to_files(state.stream_sequences(in_order(holed(spark, d))), "windows")
    return window_sums(out)


@cat.query(
    sql(
        HOLED,
        steps("holed", "src0"),
        windows_sql("h > 1.5"),
        body=WINDOW_OUT + """ WHERE "timestamp" >= TIMESTAMP '2024-01-15'""",
    )
)
def stream_prewarm(spark, d):
    """The stream starts in mid-month; the rows before it are the initial state."""
    state.use_rocksdb(spark)
    rows = holed(spark, d)
    fresh = in_order(rows.where("timestamp >= '2024-01-15'"))
    out = state.stream_sequences(fresh, history=rows.where("timestamp < '2024-01-15'"))
    return window_sums(jobs.run_to_files(out, "windows"))


@cat.query(
    q_alerts.with_sql(
        q_alerts.KEY_SQL,
        q_alerts.BROKEN_KEY,
        body="""SELECT key AS alert_key, min(id) AS id, arg_max(severity, id) AS severity, arg_max(value, id) AS observed_value
FROM (SELECT * EXCLUDE (key), fkey AS key FROM fixed) GROUP BY key""",
    )
)
def stream_alert_sink(spark, d):
    rows = alerts.with_alert_keys(q_alerts.log(spark, d))
    path = work_path(spark, "alert_log")
    jobs.alert_sink(in_order(rows), path, work_path(spark, "alert_checkpoint")).awaitTermination()
    return alerts.read_log(spark, path).select("alert_key", "id", "severity", "observed_value")


@cat.query(
    sql(
        *service_ctes("sparse"),
        body="""SELECT station_id, count(*) AS processed, count(*) FILTER (qc_flag <> 'PASSED') AS anomalies, max("timestamp") AS last_timestamp FROM qc GROUP BY 1""",
    )
)
def replay_progress(spark, d):
    return jobs.replay_progress(qc_stream(spark, d))


@cat.query(
    sql(
        *service_ctes("sparse"),
        body="""SELECT station_id, hour AS window_start, count(*) AS rows, count(*) FILTER (qc_flag = 'SUSPECT') AS suspect, count(*) FILTER (qc_flag = 'MISSING') AS missing
FROM (SELECT *, unnest([time_bucket(INTERVAL 12 HOUR, "timestamp", TIMESTAMP '2024-01-01') - INTERVAL 12 HOUR, time_bucket(INTERVAL 12 HOUR, "timestamp", TIMESTAMP '2024-01-01')]) AS hour FROM qc) GROUP BY ALL""",
    )
)
def windowed_health_stream(spark, d):
    """Day-long windows every twelve hours (the batch form of the watermarked stream)."""
    return jobs.windowed_health(quality_control(clean_sparse(spark, d)), "24 hours", "12 hours")


# Rows arrive by week.  One hour in five comes four days behind its time, one in seventeen
# twelve days behind.  A row's arrival is the week it comes in.
def arriving_late(rows):
    hour = F.expr("cast(unix_micros(cast(timestamp as timestamp)) div 3600000000 as long)")
    behind = F.when(hour % 17 == 0, 12).when(hour % 5 == 0, 4).otherwise(0)
    comes = F.datediff(F.col("timestamp"), F.lit("2024-01-01")) + behind
    rows = cut(rows.withColumn("_week", F.least(F.floor(comes / 7), F.lit(4))), "late-rows")
    return [rows.where(F.col("_week") == k).drop("_week") for k in range(5)]


def arrivals_sql(name):
    """`came` with the week a row comes in, and `mark`: how far event time had got before each week."""
    return f"""came AS (SELECT *, least((date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', "timestamp")) + CASE WHEN hour_no % 17 = 0 THEN 12 WHEN hour_no % 5 = 0 THEN 4 ELSE 0 END) // 7, 4) AS week
  FROM (SELECT *, epoch_us("timestamp") // 3600000000 AS hour_no FROM {name})),
mark AS (SELECT w.week, (SELECT max("timestamp") FROM came c WHERE c.week < w.week) AS seen, (SELECT max("timestamp") FROM came) AS last FROM (SELECT DISTINCT week FROM came) w)"""


@cat.query(
    sql(
        *service_ctes("sparse"),
        arrivals_sql("qc"),
        """placed AS (SELECT came.*, seen, last, unnest([time_bucket(INTERVAL 12 HOUR, "timestamp", TIMESTAMP '2024-01-01') - INTERVAL 12 HOUR, time_bucket(INTERVAL 12 HOUR, "timestamp", TIMESTAMP '2024-01-01')]) AS hour
  FROM came JOIN mark USING (week))""",
        body="""SELECT station_id, hour AS window_start, count(*) AS rows, count(*) FILTER (qc_flag = 'SUSPECT') AS suspect, count(*) FILTER (qc_flag = 'MISSING') AS missing
FROM placed WHERE (seen IS NULL OR hour + INTERVAL 24 HOUR > seen - INTERVAL 3 DAY) AND hour + INTERVAL 24 HOUR <= last - INTERVAL 3 DAY GROUP BY ALL""",
    )
)
def windowed_health_watermark(spark, d):
    """Day-long windows every twelve hours on a stream with late files: each window comes out
    once, when the watermark (three days behind) has passed it, without the rows that came too late."""
    rows = quality_control(clean_sparse(spark, d)).select(*KEYS, "qc_flag")
    job = lambda stream: jobs.windowed_health(stream, "24 hours", "12 hours", late="3 days")
    return jobs.run_arrivals(arriving_late(rows), job, "windowed")


@cat.query(
    sql(
        SPARSE,
        """seg AS (SELECT station_id, "timestamp", sum(CASE WHEN "timestamp" - prev > INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY station_id ORDER BY "timestamp") AS segment_id
  FROM (SELECT *, lag("timestamp") OVER (PARTITION BY station_id ORDER BY "timestamp") AS prev FROM sparse))""",
        body="""SELECT station_id, CAST(segment_id AS BIGINT) AS segment_id, min("timestamp") AS segment_start, max("timestamp") AS segment_end, count(*) AS rows
FROM seg GROUP BY station_id, segment_id HAVING max("timestamp") + INTERVAL 1 HOUR < (SELECT max("timestamp") FROM sparse) - INTERVAL 5 DAY""",
    )
)
def stream_segments(spark, d):
    """Segments as session windows over files of which some rows come four days late, numbered
    as `segment_ids` does; those still open when the stream ends are left out."""
    rows = clean_sparse(spark, d).select(*KEYS)
    hour = F.expr("cast(unix_micros(cast(timestamp as timestamp)) div 3600000000 as long)")
    comes = F.datediff(F.col("timestamp"), F.lit("2024-01-01")) + F.when(hour % 5 == 0, 4).otherwise(0)
    rows = cut(rows.withColumn("_week", F.least(F.floor(comes / 7), F.lit(4))), "late-rows")
    arrivals = [rows.where(F.col("_week") == k).drop("_week") for k in range(5)]
    found = jobs.run_arrivals(arrivals, lambda stream: jobs.segments(stream, 1.0, late="5 days"), "segments")
    number = F.row_number().over(Window.partitionBy("station_id").orderBy("segment_start")) - 1
    return found.select("station_id", number.cast("long").alias("segment_id"), "segment_start", "segment_end", "rows")


@cat.query(
    sql(
        *service_ctes("sparse"),
        body="""SELECT CASE WHEN "timestamp" < TIMESTAMP '2024-01-09' THEN 0 WHEN "timestamp" < TIMESTAMP '2024-01-17' THEN 1 WHEN "timestamp" < TIMESTAMP '2024-01-25' THEN 2 ELSE 3 END AS part,
  count(*) AS rows, count(*) FILTER (qc_flag <> 'PASSED') AS anomalies, max("timestamp") AS last_timestamp FROM qc GROUP BY 1""",
    )
)
def stream_progress(spark, d):
    """What the stream reports of itself while it runs, by the period its micro-batches lie in."""
    state.use_rocksdb(spark)
    rows = in_order(clean_sparse(spark, d).select(*KEYS, *CHANNELS))
    _, report = jobs.observed_progress(state.stream_qc(rows), "progress")
    part = F.lit(0)
    for day in ("2024-01-09", "2024-01-17", "2024-01-25"):
        part = part + (F.col("last_timestamp") >= day).cast("int")
    return report.groupBy(part.alias("part")).agg(F.sum("rows").alias("rows"), F.sum("anomalies").alias("anomalies"), F.max("last_timestamp").alias("last_timestamp"))
