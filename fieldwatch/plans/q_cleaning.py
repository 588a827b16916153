"""Queries: column checks, coercion, row selection."""

from pyspark.sql import functions as F

from fieldwatch.config import CHANNELS
from fieldwatch.functions import text
from fieldwatch.operators import cleaning
from fieldwatch.plans.catalog import Catalog
from fieldwatch.plans.driver_views import clean_sparse, dense, holed, sparse, table
from fieldwatch.plans.q_tables import raw_layout
from fieldwatch.plans.sqltext import DENSE, SPARSE, sql
from fieldwatch.plans.driver_views import HOLED

cat = Catalog()
KEYS = ["station_id", "timestamp"]


@cat.query(sql(SPARSE, body="SELECT station_id, count(*) AS rows FROM sparse_raw GROUP BY 1"))
def validate_columns(spark, d):
    rows = cleaning.validate_columns(raw_layout(sparse(spark, d)))
    return rows.groupBy("station_id").agg(F.count(F.lit(1)).alias("rows"))


@cat.query(
    sql(
        SPARSE,
        body="""SELECT station_id, strftime("timestamp", '%-m/%-d/%Y %-H:%M') AS "timestamp", temperature,
  pressure, CAST(NULL AS DOUBLE) AS wind_speed, CAST(NULL AS DOUBLE) AS wind_direction,
  humidity AS relative_humidity FROM sparse_raw""",
    )
)
def canonicalize_columns(spark, d):
    return cleaning.canonicalize_columns(raw_layout(sparse(spark, d)))


@cat.query(sql(SPARSE, body='SELECT station_id, "timestamp", temperature, pressure, humidity FROM sparse'))
def sentinel_to_null(spark, d):
    return cleaning.sentinels_to_null(sparse(spark, d), CHANNELS).drop("station_no")


@cat.query(
    sql(
        SPARSE,
        body="""SELECT count(*) FILTER (temperature IN (-999, -9999)) AS temperature,
  count(*) FILTER (pressure IN (-999, -9999)) AS pressure,
  count(*) FILTER (humidity IN (-999, -9999)) AS humidity FROM sparse_raw""",
    )
)
def sentinel_counts(spark, d):
    return cleaning.sentinel_counts(sparse(spark, d), CHANNELS)


@cat.query(
    """SELECT event_id, CASE event_type WHEN 'error' THEN NULL
  WHEN 'click' THEN CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 330 MINUTE ELSE date_trunc('millisecond', ts) END
  WHEN 'view' THEN date_trunc('minute', ts)
  WHEN 'signup' THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END AS "timestamp",
  count(*) FILTER (event_type = 'error') OVER () AS unparsed FROM events"""
)
def parse_timestamps(spark, d):
    """Eight text layouts, with a zone offset, a fraction and a 12-hour clock; one is unreadable."""
    kind = F.col("event_type")
    written = (
        F.when(kind == "error", "not a time")
        .when((kind == "click") & (F.col("event_id") % 3 == 0), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when((kind == "click") & (F.col("event_id") % 3 == 1), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")))
        .when(kind == "click", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .when((kind == "view") & (F.col("event_id") % 2 == 0), F.date_format("ts", "M/d/yyyy h:mm a"))
        .when(kind == "view", F.date_format("ts", "M/d/yyyy H:mm"))
        .when(kind == "signup", F.date_format("ts", "yyyy-MM-dd"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    )
    rows = table(spark, d, "events").select("event_id", written.alias("timestamp"))
    parsed = cleaning.parse_timestamps(rows).withColumn(
        "timestamp", F.col("timestamp").cast("timestamp_ntz")
    )
    unread = parsed.agg(F.count_if(F.col("timestamp").isNull()).alias("unparsed"))
    return parsed.crossJoin(F.broadcast(unread))  # one row


@cat.query(
    """SELECT event_id, CASE WHEN isfinite(v) THEN v END AS v FROM (
  SELECT event_id, try_cast(CASE event_type WHEN 'error' THEN 'abc' WHEN 'click' THEN 'NaN'
    WHEN 'view' THEN '-inf' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS v FROM events)"""
)
def numeric_coerce(spark, d):
    kind = F.col("event_type")
    written = (
        F.when(kind == "error", "abc")
        .when(kind == "click", "NaN")
        .when(kind == "view", "-Infinity")
        .otherwise(F.col("value").cast("string"))
    )
    rows = table(spark, d, "events").select("event_id", written.alias("v"))
    return cleaning.numeric_coerce(rows, ["v"])


@cat.query(
    sql(
        DENSE,
        body="""SELECT station_id, "timestamp", temperature, pressure, humidity FROM dense
WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'""",
    )
)
def period_select(spark, d):
    return cleaning.period_select(
        dense(spark, d),
        F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"),
        F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"),
        [*KEYS, *CHANNELS],
    )


@cat.query(
    sql(
        DENSE,
        body="""SELECT station_id, "timestamp", CASE WHEN "timestamp" < TIMESTAMP '2024-01-18' THEN 'train'
  WHEN "timestamp" < TIMESTAMP '2024-01-25' THEN 'validation' ELSE 'test' END AS split FROM dense""",
    )
)
def split_by_date(spark, d):
    out = cleaning.split_by_date(
        dense(spark, d),
        F.lit("2024-01-18 00:00:00").cast("timestamp_ntz"),
        F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"),
    )
    return out.select(*KEYS, "split")


@cat.query(
    sql(
        DENSE,
        body="""SELECT station_id, "timestamp", CASE WHEN i < floor(n * 0.70::DOUBLE) THEN 'train'
  WHEN i < floor(n * 0.85::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY "timestamp") - 1 AS i,
    count(*) OVER (PARTITION BY station_id) AS n FROM dense)""",
    )
)
def split_by_fraction(spark, d):
    return cleaning.split_by_fraction(dense(spark, d)).select(*KEYS, "split")


@cat.query(
    sql(
        HOLED,
        body="""SELECT * FROM holed
WHERE temperature IS NOT NULL AND pressure IS NOT NULL AND humidity IS NOT NULL""",
    )
)
def complete_cases(spark, d):
    return cleaning.complete_cases(holed(spark, d), CHANNELS)


@cat.query(
    sql(
        DENSE,
        body="""SELECT a.station_id, a."timestamp", a.temperature, e."timestamp" AS event_time
FROM dense a JOIN dense e ON a.station_id = e.station_id AND e.temperature > -5
  AND a."timestamp" BETWEEN e."timestamp" - INTERVAL 6 HOUR AND e."timestamp" + INTERVAL 6 HOUR""",
    )
)
def case_window(spark, d):
    rows = dense(spark, d)
    cases = rows.where("temperature > -5").select("station_id", F.col("timestamp").alias("event_time"))
    return cleaning.case_window(rows, cases, 6).select(*KEYS, "temperature", "event_time")


@cat.query(
    sql(
        DENSE,
        """cases AS (
  SELECT event_id, 'ST-' || CAST(user_id // 75 AS VARCHAR) AS station_id,
    CASE WHEN event_type = 'error' THEN date_trunc('hour', ts) ELSE ts END AS case_time FROM events)""",
        body="""SELECT c.*, CASE WHEN x.station_id IS NOT NULL THEN 'exact' WHEN m.station_id IS NOT NULL THEN 'minute' END AS match,
  coalesce(x."timestamp", m."timestamp") AS matched_time, coalesce(x.temperature, m.temperature) AS temperature
FROM cases c LEFT JOIN dense x ON x.station_id = c.station_id AND x."timestamp" = c.case_time
LEFT JOIN dense m ON m.station_id = c.station_id AND m."timestamp" = date_trunc('minute', c.case_time)""",
    )
)
def case_lookup(spark, d):
    cases = table(spark, d, "events").select(
        "event_id",
        F.concat(F.lit("ST-"), F.expr("user_id div 75").cast("string")).alias("station_id"),
        F.when(F.col("event_type") == "error", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
        .otherwise(F.col("ts"))
        .alias("case_time"),
    )
    return cleaning.case_lookup(dense(spark, d), cases, ["temperature"])


NAMES_SQL = """SELECT event_id, name,
  CASE WHEN name = 'wind' THEN NULL WHEN event_type = 'click' THEN 'temperature'
       WHEN event_type IN ('view', 'signup') THEN 'pressure' ELSE 'humidity' END AS parameter
FROM (SELECT event_id, event_type, CASE event_type WHEN 'click' THEN ' Air Temperature ' WHEN 'view' THEN 'PRESS'
  WHEN 'purchase' THEN 'relative humidity (%)' WHEN 'signup' THEN 'Sea level pressure' ELSE 'wind' END AS name FROM events)"""


def named(spark, d):
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        "event_id",
        F.when(kind == "click", " Air Temperature ")
        .when(kind == "view", "PRESS")
        .when(kind == "purchase", "relative humidity (%)")
        .when(kind == "signup", "Sea level pressure")
        .otherwise("wind")
        .alias("name"),
    )


@cat.query(NAMES_SQL)
def normalize_parameter_name(spark, d):
    return named(spark, d).withColumn("parameter", text.normalize_parameter(F.col("name")))


@cat.query(
    f"""SELECT event_id, CASE parameter WHEN 'temperature' THEN '°C' WHEN 'pressure' THEN 'hPa'
  WHEN 'humidity' THEN '%' END AS unit FROM ({NAMES_SQL})"""
)
def parameter_unit(spark, d):
    rows = named(spark, d)
    return rows.select("event_id", text.parameter_unit(text.normalize_parameter(F.col("name"))).alias("unit"))


CLASS_OF = """CASE event_type WHEN 'click' THEN 'likely_sensor_data_fault' WHEN 'view' THEN
  'LIKELY_GENUINE_WEATHER_EVENT' WHEN 'signup' THEN 'UNCERTAIN' WHEN 'purchase' THEN 'NORMAL' END"""


@cat.query(
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'Likely Sensor/Data Fault' WHEN 'view' THEN
  'Likely Genuine Weather Event' WHEN 'signup' THEN 'Uncertain' ELSE 'Normal' END AS label FROM events"""
)
def label_classification(spark, d):
    rows = table(spark, d, "events").select("event_id", F.expr(CLASS_OF).alias("c"))
    return rows.select("event_id", text.classification_label(F.col("c")).alias("label"))
