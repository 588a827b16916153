"""Queries: the alert log, built from `events` (repeated keys, old and new payload layouts)."""

from pyspark.sql import functions as F

from fieldwatch.operators import alerts
from fieldwatch.plans.catalog import Catalog
from fieldwatch.plans.driver_views import table
from fieldwatch.plans.q_fusion import action_sql
from fieldwatch.session import work_path

cat = Catalog()

# The log's source columns, the same in both engines.
BASE = """SELECT event_id AS id, {name} AS station_id, {hour} AS "timestamp", event_type,
    CASE event_type WHEN 'click' THEN 'LIKELY_SENSOR_DATA_FAULT' WHEN 'view' THEN 'LIKELY_GENUINE_WEATHER_EVENT' WHEN 'signup' THEN 'UNCERTAIN' ELSE 'NORMAL' END AS classification,
    CASE WHEN k < 20 THEN 'CRITICAL' WHEN k < 40 THEN 'HIGH' WHEN k < 60 THEN 'MEDIUM' WHEN k < 80 THEN 'LOW' ELSE 'NONE' END AS severity,
    CASE k % 4 WHEN 0 THEN ' Temperature' WHEN 1 THEN 'pressure' WHEN 2 THEN NULL ELSE '' END AS parameter,
    CASE k % 5 WHEN 0 THEN 'Rapid Temperature Change' WHEN 1 THEN 'Humidity Plausibility Violation' WHEN 2 THEN 'Communication/Data Gap' WHEN 3 THEN NULL ELSE 'Sensor freezing' END AS cause,
    k, value, {stamp} AS created_at FROM (SELECT *, {k} AS k FROM events) e"""

SQL_BASE = "base AS (" + BASE.format(
    name="'ST-' || CAST(user_id // 30 AS VARCHAR)",
    hour="date_trunc('hour', ts)",
    stamp="ts",
    k="CAST(json_extract_string(props, '$.k') AS INTEGER)",
) + ")"

KEY_SQL = """keyed AS (SELECT *, lower(trim(coalesce(nullif(parameter, ''), CASE WHEN k % 2 = 1 AND event_type = 'error' THEN 'humidity' ELSE 'observation' END))) AS kp,
    lower(trim(coalesce(nullif(cause, ''), classification))) AS kc FROM base),
log AS (SELECT *, station_id || '|' || strftime("timestamp", '%Y-%m-%d %H:%M:%S') || '|' || kp || '|' || kc AS key FROM keyed)"""


def base(spark, d):
    table(spark, d, "events").createOrReplaceTempView("events")
    text = BASE.format(
        name="concat('ST-', user_id div 30)",
        hour="cast(date_trunc('hour', ts) as timestamp_ntz)",
        stamp="ts",
        k="cast(get_json_object(props, '$.k') as int)",
    )
    return spark.sql(text.replace('"timestamp"', "`timestamp`"))


def log(spark, d):
    """Nested payloads for clicks and views, flat ones for the rest; errors carry a QC flag;
    signups above 90 have a broken payload.  Legacy rows (errors, purchases) have no key."""
    rows = base(spark, d)
    stamp = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    decision = F.struct(
        "severity",
        "classification",
        F.col("parameter").alias("primary_parameter"),
        F.col("cause").alias("probable_cause"),
        (F.col("k") / 100).alias("calibrated_confidence"),
    )
    nested = F.to_json(F.struct("station_id", stamp.alias("timestamp"), decision.alias("decision")))
    flat = F.to_json(
        F.struct(
            "station_id",
            stamp.alias("timestamp"),
            "severity",
            F.col("classification").alias("final_classification"),
            F.col("cause").alias("primary_root_cause"),
            "parameter",
            (F.col("k") * 1.0).alias("evidence_confidence"),
            F.when(
                F.col("event_type") == "error", F.struct((F.col("k") % 2 == 1).alias("humidity_spike"))
            ).alias("qc_result"),
        )
    )
    kind = F.col("event_type")
    payload = (
        F.when(kind.isin("click", "view"), nested)
        .when((kind == "signup") & (F.col("k") > 90), "{broken")
        .otherwise(flat)
    )
    return rows.select(
        "id",
        "timestamp",
        "station_id",
        "classification",
        "severity",
        F.col("value").alias("observed_value"),
        F.lit(None).cast("string").alias("previous_observation_timestamp"),
        F.when(kind == "purchase", "").alias("alert_key"),
        "parameter",
        F.lit(None).cast("string").alias("anomaly_type"),
        payload.alias("payload_json"),
        "created_at",
    )


def stored_log(spark, d):
    path = work_path(spark, "log")
    alerts.upsert_table(spark, path, log(spark, d))
    return path


NOT_BROKEN = "NOT (event_type = 'signup' AND k > 90)"
# Where the payload is broken, the row's columns give the parameter but no cause.
BROKEN_KEY = """fixed AS (SELECT *, CASE WHEN event_type = 'signup' AND k > 90 THEN
    station_id || '|' || strftime("timestamp", '%Y-%m-%d %H:%M:%S') || '|' || lower(trim(coalesce(nullif(parameter, ''), 'observation'))) || '|normal' ELSE key END AS fkey FROM log)"""


def with_sql(*ctes, body):
    return "WITH " + ", ".join([SQL_BASE, *ctes]) + " " + body


@cat.query(with_sql(KEY_SQL, BROKEN_KEY, body="SELECT id, fkey AS alert_key FROM fixed"))
def alert_key(spark, d):
    return alerts.with_alert_keys(log(spark, d)).select("id", "alert_key")


@cat.query(
    with_sql(
        KEY_SQL,
        BROKEN_KEY,
        body="SELECT id, CASE WHEN id < 5000 THEN 'known-' || CAST(id AS VARCHAR) ELSE fkey END AS alert_key FROM fixed",
    )
)
def backfill_alert_keys(spark, d):
    """Rows below 5000 already have a key, which stays."""
    rows = log(spark, d).withColumn(
        "alert_key",
        F.when(F.col("id") < 5000, F.concat(F.lit("known-"), F.col("id").cast("string"))).otherwise(F.col("alert_key")),
    )
    return alerts.with_alert_keys(rows, only_missing=True).select("id", "alert_key")


@cat.query(
    with_sql(
        KEY_SQL,
        body="""SELECT id, key AS alert_key, severity FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS r FROM log WHERE event_type IN ('click', 'view')) WHERE r = 1""",
    )
)
def dedup_alerts(spark, d):
    """Only clicks and views have keys; the rest are dropped, as rows without a key are."""
    rows = log(spark, d)
    nested = F.col("classification").isin("LIKELY_SENSOR_DATA_FAULT", "LIKELY_GENUINE_WEATHER_EVENT")
    keyed = alerts.with_alert_keys(rows).withColumn("alert_key", F.when(nested, F.col("alert_key")))
    return alerts.dedup_alerts(keyed).select("id", "alert_key", "severity")


UPSERT = """both_ AS (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE 1 END AS src FROM log),
up AS (SELECT key, arg_min(id, src * 1000000000000 + id) AS id, arg_min(created_at, src * 1000000000000 + id) AS created_at,
    arg_max(severity, src * 1000000000000 + id) AS severity, arg_max(value, src * 1000000000000 + id) AS observed_value FROM both_ GROUP BY key)"""


def _same_cause(rows):
    """Make keys of the two sets meet: drop the class from the cause."""
    classes = "likely_sensor_data_fault|likely_genuine_weather_event|uncertain|normal"
    return rows.withColumn("alert_key", F.regexp_replace("alert_key", rf"\|({classes})$", "|none"))


@cat.query(
    with_sql(
        KEY_SQL.replace("log AS (SELECT", "log0 AS (SELECT"),
        BROKEN_KEY.replace("FROM log)", "FROM log0)"),
        r"""log AS (SELECT * EXCLUDE (key), regexp_replace(fkey, '\|(likely_sensor_data_fault|likely_genuine_weather_event|uncertain|normal)$', '|none') AS key FROM fixed)""",
        UPSERT,
        body="SELECT id, key AS alert_key, severity, observed_value, created_at FROM up",
    )
)
def upsert_observation_log(spark, d):
    """Clicks and views are stored first, then all other types arrive: some keys are known."""
    path = work_path(spark, "log")
    rows = alerts.with_alert_keys(log(spark, d))
    rows = _same_cause(rows)
    early = F.col("classification").isin("LIKELY_SENSOR_DATA_FAULT", "LIKELY_GENUINE_WEATHER_EVENT")
    for part in (rows.where(early), rows.where(~early)):
        alerts.upsert_table(spark, path, part)
    return alerts.read_log(spark, path).select("id", "alert_key", "severity", "observed_value", "created_at")


@cat.query(
    with_sql(
        body="""SELECT id, station_id, "timestamp", severity FROM base WHERE classification = 'UNCERTAIN' AND severity = 'HIGH'
AND station_id = 'ST-1' AND lower(coalesce(parameter, '')) = 'pressure' AND "timestamp" >= TIMESTAMP '2024-01-13'"""
    )
)
def alert_filter(spark, d):
    out = alerts.alert_filter(
        log(spark, d),
        severity="high",
        classification="uncertain",
        station_id="ST-1",
        parameter="Pressure",
        time_range="7D",
        now=F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"),
    )
    return out.select("id", "station_id", "timestamp", "severity")


@cat.query(
    with_sql(
        body="""SELECT id, "timestamp", station_id, classification, count(*) OVER () AS total, (count(*) OVER () + 24) // 25 AS total_pages
FROM base WHERE classification <> 'NORMAL' AND severity = 'CRITICAL' ORDER BY "timestamp" DESC, id DESC LIMIT 25 OFFSET 50"""
    )
)
def alerts_page(spark, d):
    """From the stored log, opening its newest days only."""
    out = alerts.log_page(spark, stored_log(spark, d), page=3, page_size=25, severity="critical")
    return out.select("id", "timestamp", "station_id", "classification", "total", "total_pages")


@cat.query(
    with_sql(
        body="""SELECT severity, count(id) AS alerts FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) s(severity)
LEFT JOIN (SELECT * FROM base WHERE classification <> 'NORMAL') b USING (severity) GROUP BY severity"""
    )
)
def severity_counts(spark, d):
    return alerts.severity_counts(log(spark, d))


STATUS = """CASE severity WHEN 'CRITICAL' THEN 'Inspection Recommended' WHEN 'HIGH' THEN 'Inspection Recommended'
  WHEN 'MEDIUM' THEN 'Monitor Closely' WHEN 'LOW' THEN 'Monitor' ELSE 'Normal' END"""


@cat.query(
    with_sql(
        body=f"""SELECT id, {STATUS} AS maintenance_status, {action_sql("coalesce(cause, '')")} AS maintenance_action FROM base WHERE {NOT_BROKEN}"""
    )
)
def alert_maintenance(spark, d):
    return alerts.with_maintenance(log(spark, d)).select("id", "maintenance_status", "maintenance_action")


@cat.query(
    with_sql(
        body=f"""SELECT id, severity, {STATUS} AS maintenance_status, {action_sql("coalesce(cause, '')")} AS maintenance_action FROM base WHERE id = 123 AND {NOT_BROKEN}"""
    )
)
def alert_by_id(spark, d):
    """From the stored log, by its entries and bloom filters."""
    found = alerts.log_row(spark, stored_log(spark, d), 123)
    return alerts.with_maintenance(found).select("id", "severity", "maintenance_status", "maintenance_action")


@cat.query(with_sql(body="SELECT id, classification, severity FROM base WHERE classification <> 'NORMAL' AND severity = 'LOW' ORDER BY id DESC LIMIT 200"))
def recent_anomalies(spark, d):
    return alerts.recent(log(spark, d), 200, True, severity="LOW").select("id", "classification", "severity")


@cat.query(with_sql(body="SELECT id, classification, severity FROM base WHERE classification = 'NORMAL' ORDER BY id DESC LIMIT 200"))
def recent_observations(spark, d):
    return alerts.recent(log(spark, d), 200, classification="normal").select("id", "classification", "severity")


@cat.query(
    with_sql(
        body="""SELECT classification, count(*) AS rows, (SELECT count(*) FROM base WHERE classification <> 'NORMAL') AS buffer_size FROM base GROUP BY 1"""
    )
)
def alert_statistics(spark, d):
    return alerts.alert_statistics(log(spark, d))


@cat.query(
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'error'"""
)
def payload_fields(spark, d):
    """Error rows get a cut-off text, which is skipped."""
    rows = table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", F.substring("props", 1, 5)).otherwise(F.col("props")).alias("props"),
    )
    return alerts.payload_fields(rows, "props", {"k": "bigint"}).drop("props")


@cat.query(
    with_sql(
        body=f"""SELECT id, CASE WHEN {NOT_BROKEN} THEN classification ELSE 'NORMAL' END AS payload_class,
  CASE WHEN {NOT_BROKEN} THEN severity ELSE 'NORMAL' END AS payload_severity,
  CASE WHEN NOT {NOT_BROKEN} THEN NULL WHEN event_type IN ('click', 'view') THEN round(k / 100 * 100, 6) WHEN k <= 1 THEN k * 100.0::DOUBLE ELSE k::DOUBLE END AS payload_confidence,
  CASE WHEN {NOT_BROKEN} THEN coalesce(cause, 'No significant anomaly') ELSE 'No significant anomaly' END AS payload_cause, '—' AS payload_maintenance FROM base"""
    )
)
def normalize_payload(spark, d):
    out = alerts.normalize_payload(log(spark, d))
    return out.select(
        "id",
        "payload_class",
        "payload_severity",
        F.round("payload_confidence", 6).alias("payload_confidence"),
        "payload_cause",
        "payload_maintenance",
    )


@cat.query(
    with_sql(
        KEY_SQL,
        BROKEN_KEY,
        body="""SELECT key AS alert_key, arg_max(id, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END * 1000000000000 + id) AS id
FROM (SELECT * EXCLUDE key, station_id || '|' || string_split(fkey, '|')[3] AS key FROM fixed) GROUP BY key""",
    )
)
def merge_prefer_new(spark, d):
    """Clicks are the rows at hand, all others the fetched ones; merged by station and parameter."""
    rows = alerts.with_alert_keys(log(spark, d)).withColumn(
        "alert_key", F.concat_ws("|", "station_id", "parameter")
    )
    at_hand = F.col("classification") == "LIKELY_SENSOR_DATA_FAULT"
    old, new = rows.where(at_hand), rows.where(~at_hand)
    return alerts.merge_prefer_new(old, new).select("alert_key", "id")


@cat.query(with_sql(body="SELECT count(*) AS deleted, CAST(0 AS BIGINT) AS remaining FROM base"))
def clear_log(spark, d):
    path = stored_log(spark, d)
    deleted = alerts.clear_log(spark, path)
    left = alerts.read_log(spark, path)
    return left.agg(F.lit(deleted).cast("long").alias("deleted"), F.count(F.lit(1)).alias("remaining"))
