"""Observation tables derived from the `events` table, as Spark frames and as SQL.

Stations are groups of users, so their number grows with the data; one row per
(station, hour).  Arithmetic is on integer cents, so both engines agree exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Declared, so that opening the table reads no file footers.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def _hour(ts):
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def _events(spark, sf_dir, users_per_station):
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        "event_type",
        "ts",
        "user_id",
        F.expr(f"user_id div {users_per_station}").alias("station_no"),
        _hour(F.col("ts")).alias("timestamp"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
    )


def station_name(no):
    return F.concat(F.lit("ST-"), no.cast("string"))


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly rows with sentinel -999 where a channel had no event in the hour."""
    e = _events(spark, sf_dir, 30)

    def mean_cents(*kinds):
        mine = F.col("event_type").isin(*kinds)
        return (F.sum(F.when(mine, F.col("cents"))), F.count(F.when(mine, 1)))

    agg = e.groupBy("station_no", "timestamp").agg(
        *[
            x.alias(f"{n}{i}")
            for n, kinds in (("t", ("click", "view")), ("p", ("purchase", "signup")), ("h", ("error",)))
            for i, x in enumerate(mean_cents(*kinds))
        ]
    )
    return agg.select(
        station_name(F.col("station_no")).alias("station_id"),
        "station_no",
        "timestamp",
        F.expr("if(t1 > 0, cast(-30 + (t0 div t1) div 400 as double), -999D)").alias("temperature"),
        F.expr("if(p1 > 0, cast(900 + (p0 div p1) div 400 as double), -999D)").alias("pressure"),
        F.expr("if(h1 > 0, cast(10 * ((h0 div h1) div 1000) as double), -999D)").alias("humidity"),
    )


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly rows, every channel present."""
    agg = (
        _events(spark, sf_dir, 75)
        .groupBy("station_no", "timestamp")
        .agg(
            F.sum("cents").alias("s"),
            F.count("cents").alias("n"),
            F.max("cents").alias("hi"),
            F.min("cents").alias("lo"),
        )
    )
    return agg.select(
        station_name(F.col("station_no")).alias("station_id"),
        "station_no",
        "timestamp",
        F.expr("cast(-30 + (s div n) div 400 as double)").alias("temperature"),
        F.expr("cast(900 + hi div 400 as double)").alias("pressure"),
        F.expr("cast(20 + 10 * (lo div 500) as double)").alias("humidity"),
    )


def clean_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldwatch.operators.cleaning import sentinels_to_null

    return sentinels_to_null(sparse(spark, sf_dir), ["temperature", "pressure", "humidity"])


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense rows with missing cells: temperature where humidity is 50 or more, pressure
    above 975, humidity where the pressure is below 903."""
    d = dense(spark, sf_dir)
    t, p, h = F.col("temperature"), F.col("pressure"), F.col("humidity")
    return d.select(
        "station_id",
        "timestamp",
        F.when(h < 50, t).alias("temperature"),
        F.when(p <= 975, p).alias("pressure"),
        F.when(p >= 903, h).alias("humidity"),
    )


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Un-aggregated rows: several per (station, hour)."""
    e = _events(spark, sf_dir, 30)
    return e.select(
        "event_id",
        station_name(F.col("station_no")).alias("station_id"),
        "timestamp",
        F.expr("cast(-30 + cents div 400 as double)").alias("temperature"),
    )


def stations(spark: SparkSession, sf_dir: str, users_per_station: int = 75) -> DataFrame:
    """One row per station: coordinates from its number, neighbours = the next two numbers."""
    no = (
        table(spark, sf_dir, "events")
        .select(F.expr(f"user_id div {users_per_station}").alias("station_no"))
        .distinct()
    )
    n = no.agg((F.max("station_no") + 1).alias("n"))
    return no.crossJoin(F.broadcast(n)).select(  # n is a single row
        station_name(F.col("station_no")).alias("station_id"),
        F.concat(F.lit("Station "), F.col("station_no").cast("string")).alias("station_name"),
        (F.lit(-70.0) - F.col("station_no") / 100).alias("latitude"),
        (F.lit(11.0) + F.col("station_no") / 50).alias("longitude"),
        (F.lit(100.0) + F.expr("5 * (station_no % 7)")).alias("elevation_m"),
        (F.col("station_no") == 0).alias("is_primary"),
        station_name(F.expr("(station_no + 1) % n")).alias("neighbour_1"),
        station_name(F.expr("(station_no + 2) % n")).alias("neighbour_2"),
    )


# ---------------------------------------------------------------------------------
# The same tables as SQL text.  Each is a list of CTEs to put after WITH.
_E = """ev{u} AS (
  SELECT event_id, event_type, ts, user_id, user_id // {u} AS station_no,
         date_trunc('hour', ts) AS "timestamp", CAST(round(value * 100) AS BIGINT) AS cents
  FROM events)"""

SPARSE = (
    _E.format(u=30)
    + """, sparse_raw AS (
  SELECT 'ST-' || CAST(station_no AS VARCHAR) AS station_id, station_no, "timestamp",
    CASE WHEN count(*) FILTER (event_type IN ('click','view')) > 0 THEN CAST(-30 + (CAST(sum(cents) FILTER (event_type IN ('click','view')) AS BIGINT) // count(*) FILTER (event_type IN ('click','view'))) // 400 AS DOUBLE) ELSE -999.0 END AS temperature,
    CASE WHEN count(*) FILTER (event_type IN ('purchase','signup')) > 0 THEN CAST(900 + (CAST(sum(cents) FILTER (event_type IN ('purchase','signup')) AS BIGINT) // count(*) FILTER (event_type IN ('purchase','signup'))) // 400 AS DOUBLE) ELSE -999.0 END AS pressure,
    CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN CAST(10 * ((CAST(sum(cents) FILTER (event_type = 'error') AS BIGINT) // count(*) FILTER (event_type = 'error')) // 1000) AS DOUBLE) ELSE -999.0 END AS humidity
  FROM ev30 GROUP BY station_no, "timestamp"),
sparse AS (
  SELECT station_id, station_no, "timestamp",
    nullif(temperature, -999) AS temperature, nullif(pressure, -999) AS pressure,
    nullif(humidity, -999) AS humidity FROM sparse_raw)"""
)

DENSE = (
    _E.format(u=75)
    + """, dense AS (
  SELECT 'ST-' || CAST(station_no AS VARCHAR) AS station_id, station_no, "timestamp",
    CAST(-30 + (CAST(sum(cents) AS BIGINT) // count(cents)) // 400 AS DOUBLE) AS temperature,
    CAST(900 + max(cents) // 400 AS DOUBLE) AS pressure,
    CAST(20 + 10 * (min(cents) // 500) AS DOUBLE) AS humidity
  FROM ev75 GROUP BY station_no, "timestamp")"""
)

HOLED = (
    DENSE
    + """, holed AS (
  SELECT station_id, "timestamp", CASE WHEN humidity < 50 THEN temperature END AS temperature,
    CASE WHEN pressure <= 975 THEN pressure END AS pressure,
    CASE WHEN pressure >= 903 THEN humidity END AS humidity FROM dense)"""
)

RAW_ROWS = (
    _E.format(u=30)
    + """, raw_rows AS (
  SELECT event_id, 'ST-' || CAST(station_no AS VARCHAR) AS station_id, "timestamp",
         CAST(-30 + cents // 400 AS DOUBLE) AS temperature FROM ev30)"""
)


STATIONS = """station_nos AS (SELECT DISTINCT user_id // 75 AS station_no FROM events),
stations AS (
  SELECT 'ST-' || CAST(station_no AS VARCHAR) AS station_id,
    'Station ' || CAST(station_no AS VARCHAR) AS station_name,
    -70.0::DOUBLE - station_no::DOUBLE / 100 AS latitude, 11.0::DOUBLE + station_no::DOUBLE / 50 AS longitude,
    100.0::DOUBLE + 5 * (station_no % 7) AS elevation_m, station_no = 0 AS is_primary,
    'ST-' || CAST((station_no + 1) % n AS VARCHAR) AS neighbour_1,
    'ST-' || CAST((station_no + 2) % n AS VARCHAR) AS neighbour_2
  FROM station_nos, (SELECT max(station_no) + 1 AS n FROM station_nos))"""
