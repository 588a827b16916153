"""Queries: sources and sinks (written to the shared work folder and read back)."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwatch.operators.cleaning import sentinels_to_null
from fieldwatch.operators.profile import qc_summary
from fieldwatch.operators.qc import quality_control
from fieldwatch.plans.catalog import Catalog
from fieldwatch.plans.driver_views import clean_sparse, dense, sparse, stations, table
from fieldwatch.plans.sqltext import DENSE, QC_COLUMNS, SPARSE, STATIONS, service_ctes, sql
from fieldwatch.session import cut, work_path
from fieldwatch.sources import tables

cat = Catalog()

RAW_WITH_STATION = T.StructType([T.StructField("station_id", T.StringType()), *tables.RAW_SCHEMA])


def raw_layout(df):
    """Observations in the raw file layout, time as text."""
    empty = F.lit(None).cast("double")
    return df.select(
        "station_id",
        F.date_format("timestamp", "M/d/yyyy H:mm").alias("TimeStamp"),
        F.col("temperature").alias("Air Temperature"),
        F.col("pressure").alias("Air Pressure"),
        empty.alias("Wind Speed"),
        empty.alias("Wind Direction"),
        F.col("humidity").alias("Relative Humidity"),
    )


@cat.query(
    sql(
        SPARSE,
        body="""SELECT station_id, strftime("timestamp", '%-m/%-d/%Y %-H:%M') AS "TimeStamp",
  temperature AS "Air Temperature", pressure AS "Air Pressure", CAST(NULL AS DOUBLE) AS "Wind Speed",
  CAST(NULL AS DOUBLE) AS "Wind Direction", humidity AS "Relative Humidity" FROM sparse_raw""",
    )
)
def read_obs_csv(spark, d):
    path = work_path(spark, "raw")
    tables.write_obs_csv(raw_layout(sparse(spark, d)), path)
    return tables.read_obs_csv(spark, path, schema=RAW_WITH_STATION)


@cat.query()
def source_manifest(spark, d):
    """Checksums of the given tables' files, compared with a second reading."""
    first, second = cut(tables.source_manifest(spark, d), "manifest"), tables.source_manifest(spark, d)
    status = tables.compare_manifests(first.drop("modified"), second.drop("modified"))
    return (
        first.join(status, "path")
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), "sha256", "size", "status")
    )


@cat.query(sql(DENSE, body='SELECT station_id, "timestamp", temperature, pressure, humidity FROM dense'))
def read_obs_parquet(spark, d):
    path = work_path(spark, "dense")
    rows = dense(spark, d).drop("station_no")
    rows.write.parquet(path)
    return tables.read_obs_parquet(spark, path, rows.schema)


@cat.query(sql(SPARSE, body='SELECT station_id, "timestamp", temperature, pressure, humidity FROM sparse'))
def write_clean_parquet(spark, d):
    path = work_path(spark, "clean")
    tables.write_clean_parquet(clean_sparse(spark, d).drop("station_no"), path)
    return tables.read_obs_parquet(spark, path).drop("day")


@cat.query(sql(*service_ctes("sparse"), body=f"SELECT {QC_COLUMNS} FROM qc"))
def write_obs_csv(spark, d):
    path = work_path(spark, "qc_csv")
    qc = quality_control(clean_sparse(spark, d))
    flat = qc.withColumn("reasons", F.concat_ws("; ", "qc_reasons")).drop("qc_reasons")
    tables.write_obs_csv(flat, path)
    # An empty text is written as an empty field and read as missing.
    return tables.read_obs_csv(spark, path, schema=flat.schema).fillna("", ["reasons"])


@cat.query(
    sql(
        *service_ctes("sparse"),
        body="""SELECT station_id, count(*) AS rows,
  count(*) FILTER (qc_flag = 'PASSED') AS flag_passed, count(*) FILTER (qc_flag = 'SUSPECT') AS flag_suspect,
  count(*) FILTER (qc_flag = 'MISSING') AS flag_missing, count(*) FILTER (qc_flag = 'GAP') AS flag_gap
FROM qc GROUP BY station_id""",
    )
)
def write_report_json(spark, d):
    path = work_path(spark, "report")
    report = qc_summary(quality_control(clean_sparse(spark, d)))
    tables.write_report_json(report, path)
    back = spark.read.schema(report.schema).json(path)
    return back.select("station_id", "rows", *[c for c in back.columns if c.startswith("flag_")])


EXTERNAL_SQL = """ext AS (
  SELECT event_id, 'ST-' || CAST(user_id // 30 AS VARCHAR) AS station_id,
    CASE WHEN event_type = 'error' THEN NULL ELSE date_trunc('minute', ts) END AS "timestamp",
    CASE WHEN event_type = 'click' THEN NULL ELSE value END AS temperature,
    CASE WHEN event_type = 'view' THEN NULL ELSE value + 900 END AS pressure,
    CASE WHEN event_type = 'signup' THEN NULL ELSE value END AS humidity FROM events)"""


def external_rows(spark, d):
    """Another network's text layout, with unreadable times and numbers in it."""
    kind, value = F.col("event_type"), F.col("value")
    return table(spark, d, "events").select(
        "event_id",
        F.concat(F.lit("ST-"), F.expr("user_id div 30").cast("string")).alias("station_id"),
        F.when(kind == "error", "31/31/2024 7:00").otherwise(F.date_format("ts", "d/M/yyyy H:mm")).alias("obstime"),
        F.when(kind == "click", "n/a").otherwise(value.cast("string")).alias("tempr"),
        F.when(kind == "view", "NaN").otherwise((value + 900).cast("string")).alias("ap"),
        F.when(kind == "signup", "Infinity").otherwise(value.cast("string")).alias("rh"),
    )


@cat.query(sql(EXTERNAL_SQL, body="SELECT * FROM ext"))
def ingest_external_station(spark, d):
    out = tables.ingest_external(external_rows(spark, d))
    return out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@cat.query(
    sql(
        EXTERNAL_SQL,
        body="""SELECT station_id, count(*) AS rows, min("timestamp") AS date_start, max("timestamp") AS date_end,
  count(*) - count("timestamp") AS invalid_timestamps, count(*) - count(temperature) AS temperature_missing,
  count(*) - count(pressure) AS pressure_missing, count(*) - count(humidity) AS humidity_missing,
  count(*) - count(DISTINCT "timestamp") - max(CASE WHEN "timestamp" IS NULL THEN 1 ELSE 0 END) AS duplicate_timestamps
FROM ext GROUP BY station_id""",
    )
)
def external_station_audit(spark, d):
    out = tables.ingest_external(external_rows(spark, d))
    return tables.external_audit(
        out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    )


@cat.query(sql(STATIONS, body="SELECT *, lower(station_id) = 'st-1' AS is_lookup FROM stations"))
def station_dimension(spark, d):
    dim = stations(spark, d)
    one = tables.find_station(dim, "st-1").select("station_id", F.lit(True).alias("is_lookup"))
    return dim.join(one, "station_id", "left").fillna(False, ["is_lookup"])
