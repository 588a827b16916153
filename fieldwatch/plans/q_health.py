"""Queries: sensor health."""

from pyspark.sql import functions as F

from fieldwatch.config import CHANNELS
from fieldwatch.operators import health
from fieldwatch.operators.hourly_qc import hourly_qc
from fieldwatch.operators.qc import quality_control
from fieldwatch.plans.catalog import Catalog
from fieldwatch.plans.driver_views import HOLED, dense, holed, stations
from fieldwatch.plans.sqltext import DENSE, STATIONS, flat_runs, hourly_ctes, service_qc, sql, steps
from fieldwatch.session import cut, work_path
from fieldwatch.sources.tables import append_table

cat = Catalog()
KEYS = ["station_id", "timestamp"]

QC = [HOLED, steps("holed"), flat_runs("steps", "flat", 4, "1e-4", 1.5), service_qc("flat")]


def qc_holed(spark, d):
    return quality_control(holed(spark, d))


def r6(df, columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@cat.query(
    sql(
        *QC,
        body="""SELECT station_id, "timestamp", reasons LIKE '%temp%' AS temperature_suspect, reasons LIKE '%press%' AS pressure_suspect,
  reasons LIKE '%humid%' OR reasons LIKE '%rh%' AS humidity_suspect, t_flat AS temperature_flat, p_flat AS pressure_flat, h_flat AS humidity_flat FROM qc""",
    )
)
def parameter_suspect_flags(spark, d):
    out = health.parameter_suspect_flags(qc_holed(spark, d))
    return out.select(*KEYS, *[f"{c}_{k}" for k in ("suspect", "flat") for c in CHANNELS])


LONG = """hl AS (
  SELECT station_id, "timestamp", 'temperature' AS parameter, temperature AS value, reasons LIKE '%temp%' AS suspect,
    missing_flag AS missing, t_flat AS flat FROM qc UNION ALL
  SELECT station_id, "timestamp", 'pressure', pressure, reasons LIKE '%press%', missing_flag, p_flat FROM qc UNION ALL
  SELECT station_id, "timestamp", 'humidity', humidity, reasons LIKE '%humid%' OR reasons LIKE '%rh%', missing_flag, h_flat FROM qc),
he AS (
  SELECT *, avg(CAST(suspect OR missing AS INT)) OVER (w ROWS 23 PRECEDING) AS e24,
    avg(CAST(suspect OR missing AS INT)) OVER (w ROWS 167 PRECEDING) AS e168,
    avg(CAST(suspect OR missing AS INT)) OVER (w ROWS 719 PRECEDING) AS e720,
    count(*) OVER (w ROWS UNBOUNDED PRECEDING) AS total,
    count(*) FILTER (missing) OVER (w ROWS UNBOUNDED PRECEDING) AS missing_n,
    count(*) FILTER (suspect AND NOT missing) OVER (w ROWS UNBOUNDED PRECEDING) AS suspect_n,
    sum(CASE WHEN flat THEN 0 ELSE 1 END) OVER (w ROWS UNBOUNDED PRECEDING) AS flat_block
  FROM hl WINDOW w AS (PARTITION BY station_id, parameter ORDER BY "timestamp")),
hf AS (SELECT *, count(*) FILTER (flat) OVER (PARTITION BY station_id, parameter, flat_block ORDER BY "timestamp") AS flat_run FROM he),
hv AS (
  SELECT *, value - lag(value) OVER (PARTITION BY station_id, parameter ORDER BY "timestamp") AS step FROM hl WHERE value IS NOT NULL),
hs AS (
  SELECT *, CASE WHEN count(step) OVER (w ROWS 23 PRECEDING) > 2 THEN var_pop(step) OVER (w ROWS 23 PRECEDING) ELSE 0 END AS noise,
    sum(CASE WHEN NOT suspect THEN coalesce(step - 0.5, 0) ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS su,
    sum(CASE WHEN NOT suspect THEN coalesce(-step - 0.5, 0) ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS sd
  FROM hv WINDOW w AS (PARTITION BY station_id, parameter ORDER BY "timestamp")),
hc AS (
  SELECT station_id, "timestamp", parameter, noise, greatest(su - least(0, min(su) OVER w), sd - least(0, min(sd) OVER w)) AS cusum
  FROM hs WINDOW w AS (PARTITION BY station_id, parameter ORDER BY "timestamp" ROWS UNBOUNDED PRECEDING)),
hj AS (
  SELECT hf.*, coalesce(last_value(noise IGNORE NULLS) OVER w, 0) AS noise_variance,
    coalesce(last_value(cusum IGNORE NULLS) OVER w, 0) AS cusum_drift
  FROM hf LEFT JOIN hc USING (station_id, "timestamp", parameter)
  WINDOW w AS (PARTITION BY station_id, parameter ORDER BY "timestamp" ROWS UNBOUNDED PRECEDING)),
hi AS (
  SELECT *, greatest(0, least(100, 100 - (e24 * 40 + e168 * 30 + e720 * 15
    + CASE WHEN flat_run > 3 THEN least(20.0::DOUBLE, flat_run * 3.0::DOUBLE) ELSE 0 END
    + CASE WHEN cusum_drift > 5 THEN least(15.0::DOUBLE, (cusum_drift - 5) * 2) ELSE 0 END))) AS health_index FROM hj),
hh AS (
  SELECT *, CASE WHEN health_index >= 85 THEN 'HEALTHY' WHEN health_index >= 60 THEN 'DEGRADING'
    WHEN health_index >= 30 THEN 'MAINTENANCE_REQUIRED' ELSE 'FAILED' END AS status FROM hi)"""


def long_of(spark, d):
    return health.series_rows(health.parameter_suspect_flags(qc_holed(spark, d)))


@cat.query(
    sql(
        *QC,
        LONG,
        body="""SELECT station_id, "timestamp", parameter, round(e24, 6) AS error_rate_24h, round(e168, 6) AS error_rate_7d,
  round(e720, 6) AS error_rate_30d FROM he""",
    )
)
def error_rates(spark, d):
    rates = ["error_rate_24h", "error_rate_7d", "error_rate_30d"]
    return r6(health.error_rates(long_of(spark, d)).select(*KEYS, "parameter", *rates), rates)


@cat.query(
    sql(
        *QC,
        LONG,
        body="""SELECT station_id, "timestamp", parameter, total AS total_observations, total - missing_n - suspect_n AS clean_observations,
  suspect_n AS suspect_observations, missing_n AS missing_observations FROM he""",
    )
)
def health_counters(spark, d):
    out = health.running_state(long_of(spark, d))
    return out.select(*KEYS, "parameter", *[f"{k}_observations" for k in ("total", "clean", "suspect", "missing")])


@cat.query(
    sql(*QC, LONG, body='SELECT station_id, "timestamp", parameter, flat_run AS consecutive_flatlines FROM hf')
)
def consecutive_flatlines(spark, d):
    return health.running_state(long_of(spark, d)).select(*KEYS, "parameter", "consecutive_flatlines")


@cat.query(
    sql(*QC, LONG, body='SELECT station_id, "timestamp", parameter, round(noise, 6) AS noise_variance FROM hs')
)
def step_variance(spark, d):
    out = health.step_metrics(long_of(spark, d))
    return out.select(
        F.split_part("series", F.lit("|"), F.lit(1)).alias("station_id"),
        "timestamp",
        F.split_part("series", F.lit("|"), F.lit(2)).alias("parameter"),
        F.round("noise_variance", 6).alias("noise_variance"),
    )


@cat.query(
    sql(*QC, LONG, body='SELECT station_id, "timestamp", parameter, round(cusum, 6) + 0 AS cusum_drift FROM hc')
)
def cusum_drift(spark, d):
    out = health.step_metrics(long_of(spark, d))
    return out.select(
        F.split_part("series", F.lit("|"), F.lit(1)).alias("station_id"),
        "timestamp",
        F.split_part("series", F.lit("|"), F.lit(2)).alias("parameter"),
        F.round("cusum_drift", 6).alias("cusum_drift"),
    )


@cat.query(
    sql(
        *QC,
        LONG,
        body="""SELECT station_id, "timestamp", parameter, round(noise_variance, 6) AS noise_variance, round(cusum_drift, 6) + 0 AS cusum_drift,
  round(health_index, 6) AS health_index, status FROM hh""",
    )
)
def parameter_health_index(spark, d):
    out = health.parameter_health(qc_holed(spark, d))
    nums = ["noise_variance", "cusum_drift", "health_index"]
    return r6(out.select(*KEYS, "parameter", *nums, "status"), nums)


def _alert(c, s):
    return f"""CASE max(CASE WHEN parameter = '{c}' THEN status END)
    WHEN 'DEGRADING' THEN printf('Sensor [{c}] degrading (Health: %.1f%%, 24h error rate: %.1f%%)', {s}h, max(CASE WHEN parameter = '{c}' THEN e24 END) * 100)
    WHEN 'MAINTENANCE_REQUIRED' THEN printf('Sensor [{c}] requires maintenance (Health: %.1f%%)', {s}h)
    WHEN 'FAILED' THEN printf('Sensor [{c}] has FAILED (Health: %.1f%%)', {s}h) END"""


OVERALL = "CASE WHEN {o} >= 80 AND {m} >= 60 THEN 'OPERATIONAL' WHEN {o} >= 50 AND {m} >= 30 THEN 'DEGRADED' ELSE 'CRITICAL_ATTENTION' END"


@cat.query(
    sql(
        *QC,
        LONG,
        """st AS (SELECT station_id, "timestamp", max(CASE WHEN parameter = 'temperature' THEN health_index END) AS th,
  max(CASE WHEN parameter = 'pressure' THEN health_index END) AS ph, max(CASE WHEN parameter = 'humidity' THEN health_index END) AS hh_ FROM hh GROUP BY ALL)""",
        "al AS (SELECT station_id, \"timestamp\", "
        + f"{_alert('temperature', 't')} AS a, {_alert('pressure', 'p')} AS b, {_alert('humidity', 'hh_').replace('hh_h', 'hh_')} AS c "
        + 'FROM hh JOIN st USING (station_id, "timestamp") GROUP BY station_id, "timestamp", th, ph, hh_)',
        body=f"""SELECT station_id, "timestamp", round(th * 0.4::DOUBLE + ph * 0.4::DOUBLE + hh_ * 0.2::DOUBLE, 6) AS overall_health_index,
  {OVERALL.format(o='(th * 0.4::DOUBLE + ph * 0.4::DOUBLE + hh_ * 0.2::DOUBLE)', m='least(th, ph, hh_)')} AS overall_status,
  concat_ws('; ', a, b, c) AS alerts FROM st JOIN al USING (station_id, "timestamp")""",
    )
)
def station_health(spark, d):
    out = health.station_health(health.parameter_health(qc_holed(spark, d)))
    return out.select(
        *KEYS,
        F.round("overall_health_index", 6).alias("overall_health_index"),
        "overall_status",
        F.concat_ws("; ", "active_alerts").alias("alerts"),
    )


# -- long-term ------------------------------------------------------------------------------
def longterm_sql(keys, weights=(30, 25, 20, 15, 10)):
    a, m, f, q, t = weights
    k = ", ".join(keys)
    by = f"{k}, parameter"
    return f"""hq AS (SELECT *, CAST("timestamp" AS DATE) AS day FROM qc),
ll AS (
  SELECT {k}, "timestamp", 'temperature' AS parameter, temperature AS value, qc_flag, t_spike AS anomaly, t_flat AS flat FROM hq UNION ALL
  SELECT {k}, "timestamp", 'pressure', pressure, qc_flag, p_spike, p_flat FROM hq UNION ALL
  SELECT {k}, "timestamp", 'humidity', humidity, qc_flag, h_spike, h_flat FROM hq),
fr AS (
  SELECT {by}, count(*) AS evaluation_window_hours, count(*) FILTER (anomaly) / count(*) AS anomaly_frequency,
    count(*) FILTER (value IS NULL) / count(*) AS missing_frequency, count(*) FILTER (flat) / count(*) AS flatline_frequency,
    count(*) FILTER (qc_flag = 'SUSPECT') / count(*) AS qc_violation_rate FROM ll GROUP BY ALL),
rc AS (
  SELECT {by}, CASE WHEN count(*) FILTER (r <= 24) >= 24 THEN round(avg(CAST(anomaly AS INT)) FILTER (r <= 24) - avg(CAST(anomaly AS INT)), 4) ELSE 0 END AS recent_anomaly_trend
  FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY "timestamp" DESC) AS r FROM ll) GROUP BY ALL),
lt AS (
  SELECT *, greatest(0, least(100, 100 - (anomaly_frequency * {a} + missing_frequency * {m} + flatline_frequency * {f} + qc_violation_rate * {q}
    + CASE WHEN recent_anomaly_trend > 0 THEN recent_anomaly_trend * {t} ELSE 0 END))) AS health_index
  FROM fr JOIN rc USING ({by})),
lh AS (SELECT *, CASE WHEN health_index >= 85 THEN 'HEALTHY' WHEN health_index >= 65 THEN 'DEGRADING'
    WHEN health_index >= 35 THEN 'MAINTENANCE_REQUIRED' ELSE 'FAILED' END AS status FROM lt)"""


def history(spark, d, daily=False):
    qc = qc_holed(spark, d)
    rows = qc.withColumns({f"{c}_anomaly": F.col(f"{c}_spike") for c in CHANNELS})
    return rows.withColumn("day", F.to_date("timestamp")) if daily else rows


FREQ = ["anomaly_frequency", "missing_frequency", "flatline_frequency", "qc_violation_rate"]


@cat.query(
    sql(
        *QC,
        longterm_sql(["station_id"]),
        body="SELECT station_id, parameter, evaluation_window_hours, " + ", ".join(f"round({f}, 6) AS {f}" for f in FREQ) + " FROM fr",
    )
)
def parameter_health_longterm(spark, d):
    out = health.parameter_frequencies(health.history_long(history(spark, d), ["station_id"]), ["station_id"])
    return r6(out, FREQ)


@cat.query(sql(*QC, longterm_sql(["station_id"]), body="SELECT station_id, parameter, round(recent_anomaly_trend, 4) + 0 AS recent_anomaly_trend FROM rc"))
def anomaly_trend(spark, d):
    return health.anomaly_trend(health.history_long(history(spark, d), ["station_id"]), ["station_id"])


@cat.query(
    sql(*QC, longterm_sql(["station_id"]), body="SELECT station_id, parameter, round(health_index, 6) AS health_index, status FROM lh")
)
def longterm_health_index(spark, d):
    out = health.longterm_health(history(spark, d))
    return r6(out.select("station_id", "parameter", "health_index", "status"), ["health_index"])


@cat.query(
    sql(
        *QC,
        longterm_sql(["station_id"], (50, 40, 5, 60, 20)),
        body="SELECT station_id, parameter, round(health_index, 6) AS health_index, status FROM lh",
    )
)
def recalculate_health(spark, d):
    weights = health.HealthWeights(anomaly=50.0, missing=40.0, flatline=5.0, qc=60.0, trend=20.0)
    out = health.longterm_health(history(spark, d), weights)
    return r6(out.select("station_id", "parameter", "health_index", "status"), ["health_index"])


def snap_sql(keys):
    k = ", ".join(keys)
    return f"""sn0 AS (SELECT *, CASE status WHEN 'DEGRADING' THEN printf('Sensor [%s] health degrading (Health: %.1f%%, Trend: %+.2f)', parameter, health_index, recent_anomaly_trend)
    WHEN 'MAINTENANCE_REQUIRED' THEN printf('Sensor [%s] MAINTENANCE REQUIRED (Health: %.1f%%)', parameter, health_index)
    WHEN 'FAILED' THEN printf('Sensor [%s] FAILED (Health: %.1f%%)', parameter, health_index) END AS a,
    CASE parameter WHEN 'temperature' THEN 1 WHEN 'pressure' THEN 2 ELSE 3 END AS o FROM lh),
sn AS (SELECT {k}, avg(health_index) AS overall, min(health_index) AS low, max(CASE WHEN o = 1 THEN health_index END) AS ts_,
    coalesce(string_agg(a, '; ' ORDER BY o), '') AS alerts, count(a) AS alert_count FROM sn0 GROUP BY ALL)"""


HARSH = (50, 40, 5, 60, 20)
HARSH_WEIGHTS = health.HealthWeights(anomaly=50.0, missing=40.0, flatline=5.0, qc=60.0, trend=20.0)


@cat.query(
    sql(
        *QC,
        longterm_sql(["station_id"], HARSH),
        snap_sql(["station_id"]),
        body=f"""SELECT station_id, round(overall, 6) AS overall_health_index, {OVERALL.format(o='overall', m='low')} AS overall_status,
  round(ts_, 6) AS temperature_score, alerts FROM sn""",
    )
)
def station_snapshot(spark, d):
    out = health.station_snapshot(health.longterm_health(history(spark, d), HARSH_WEIGHTS))
    return out.select(
        "station_id",
        F.round("overall_health_index", 6).alias("overall_health_index"),
        "overall_status",
        F.round(F.col("parameter_scores")["temperature"], 6).alias("temperature_score"),
        F.concat_ws("; ", "active_alerts").alias("alerts"),
    )


# -- the health log: one evaluation per station and day ---------------------------------------
DAILY = [*QC, longterm_sql(["station_id", "day"], HARSH)]
LOG_SQL = [*DAILY, snap_sql(["station_id", "day"]), """log AS (SELECT *, CAST(day AS TIMESTAMP) AS "timestamp" FROM sn)"""]


def daily_health(spark, d):
    keys = ["station_id", "day"]
    return health.longterm_health(history(spark, d, daily=True), HARSH_WEIGHTS, keys)


def log_id():
    """Id of a log row: its day number, so it grows with time."""
    return F.unix_date("day").cast("long").alias("id")


def parameter_log(spark, d):
    out = daily_health(spark, d)
    return out.select(
        log_id(), "station_id", F.col("day").cast("timestamp_ntz").alias("timestamp"), "parameter", F.round("health_index", 6).alias("health_index"), "status"
    )


def snapshot_log(spark, d):
    out = health.station_snapshot(daily_health(spark, d), ["station_id", "day"])
    return out.select(
        log_id(),
        "station_id",
        F.col("day").cast("timestamp_ntz").alias("timestamp"),
        F.round("overall_health_index", 6).alias("overall_health_index"),
        "overall_status",
        "active_alerts",
    )


@cat.query(
    sql(
        *DAILY,
        body="""SELECT datediff('day', DATE '1970-01-01', day) AS id, station_id, CAST(day AS TIMESTAMP) AS "timestamp", parameter,
  round(health_index, 6) AS health_index, status FROM lh""",
    )
)
def append_health_log(spark, d):
    """Two appends (before and from the middle of the month), then the whole log."""
    path = work_path(spark, "health_log")
    rows = cut(parameter_log(spark, d), "daily")
    for part in (F.col("timestamp") < "2024-01-15", F.col("timestamp") >= "2024-01-15"):
        append_table(rows.where(part), path)
    return spark.read.schema(rows.schema).parquet(path)


@cat.query(
    sql(
        *LOG_SQL,
        body=f"""SELECT * EXCLUDE r FROM (SELECT datediff('day', DATE '1970-01-01', day) AS id, station_id, "timestamp", round(overall, 6) AS overall_health_index,
    {OVERALL.format(o='overall', m='low')} AS overall_status, alerts, row_number() OVER (PARTITION BY station_id ORDER BY day DESC) AS r FROM log) WHERE r = 1""",
    )
)
def latest_snapshot(spark, d):
    out = health.latest_snapshot(snapshot_log(spark, d))
    return out.withColumn("alerts", F.concat_ws("; ", "active_alerts")).drop("active_alerts")


@cat.query(
    sql(
        *DAILY,
        body="""SELECT * EXCLUDE r FROM (SELECT datediff('day', DATE '1970-01-01', day) AS id, station_id, CAST(day AS TIMESTAMP) AS "timestamp", parameter,
  round(health_index, 6) AS health_index, status, row_number() OVER (PARTITION BY station_id, parameter ORDER BY day) AS r FROM lh) WHERE r <= 10""",
    )
)
def health_history(spark, d):
    return health.health_history(parameter_log(spark, d), 10)


@cat.query(
    sql(
        *DAILY,
        body="""SELECT * EXCLUDE r FROM (SELECT datediff('day', DATE '1970-01-01', day) AS id, station_id, CAST(day AS TIMESTAMP) AS "timestamp", parameter,
  round(health_index, 6) AS health_index, status, row_number() OVER (PARTITION BY station_id, parameter ORDER BY day DESC) AS r FROM lh) WHERE r = 1""",
    )
)
def latest_parameter_health(spark, d):
    return health.latest_parameter_health(parameter_log(spark, d))


@cat.query(
    sql(
        *LOG_SQL,
        """last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY day DESC) AS r FROM log) WHERE r = 1)""",
        STATIONS,
        body=f"""SELECT s.station_id, CASE WHEN l.station_id IS NULL THEN 'OPERATIONAL' ELSE {OVERALL.format(o='overall', m='low')} END AS overall_status,
  coalesce(alerts, '') AS alerts, CAST(coalesce(alert_count, 0) AS INTEGER) AS alert_count FROM stations s LEFT JOIN last l USING (station_id)""",
    )
)
def active_health_alerts(spark, d):
    out = health.active_health_alerts(stations(spark, d), snapshot_log(spark, d))
    return out.withColumn("alerts", F.concat_ws("; ", "active_alerts")).drop("active_alerts")


@cat.query(
    sql(
        *hourly_ctes(DENSE, "dense"),
        body="""SELECT station_id, round(greatest(0, 100 - (0.40::DOUBLE * q + 0.25::DOUBLE * f + 0.15::DOUBLE * r + 0.15::DOUBLE * s + 0.05::DOUBLE * g)), 6) AS health_score FROM (
  SELECT station_id, avg(CAST(qc_flag AS INT)) * 100 AS q, avg(CAST(t_flat OR p_flat OR h_flat AS INT)) * 100 AS f,
    avg(CAST(t_rate OR p_rate OR h_rate AS INT)) * 100 AS r, avg(CAST(t_spike OR p_rate OR h_rate AS INT)) * 100 AS s,
    avg(CAST(gap_flag AS INT)) * 100 AS g FROM hq GROUP BY 1)""",
    )
)
def nb_health_score(spark, d):
    out = health.hourly_health_score(hourly_qc(dense(spark, d)))
    return out.select("station_id", F.round("health_score", 6).alias("health_score"))


@cat.query(
    sql(
        *hourly_ctes(DENSE, "dense"),
        body="""SELECT station_id, "timestamp", CAST(t_rate AS INT) + 2 * CAST(p_rate AS INT) + 2 * CAST(h_rate AS INT) + CAST(t_spike AS INT)
  + CAST(t_flat AS INT) + CAST(p_flat AS INT) + CAST(h_flat AS INT) + CAST(gap_flag AS INT) AS qc_issues FROM hq""",
    )
)
def qc_issue_count(spark, d):
    return health.qc_issue_count(hourly_qc(dense(spark, d))).select(*KEYS, "qc_issues")
