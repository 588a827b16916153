"""Queries: profiles and reports."""

from pyspark.sql import functions as F

from fieldwatch.operators import profile
from fieldwatch.operators.qc import quality_control
from fieldwatch.operators.structure import dedup_timestamps
from fieldwatch.plans.catalog import Catalog
from fieldwatch.plans.driver_views import clean_sparse, dense, raw_rows
from fieldwatch.plans.q_structure import GAPS, RUNS
from fieldwatch.plans.sqltext import DENSE, RAW_ROWS, SPARSE, service_ctes, sql, steps

cat = Catalog()

LONG = """long AS (
  SELECT station_id, 'temperature' AS parameter, temperature AS v FROM {0} UNION ALL
  SELECT station_id, 'pressure', pressure FROM {0} UNION ALL
  SELECT station_id, 'humidity', humidity FROM {0})"""


@cat.query(
    sql(
        SPARSE,
        RUNS,
        body="""SELECT * FROM (SELECT station_id, parameter, count(*) - count(v) AS missing_count, count(v) AS valid_count,
  round((count(*) - count(v)) / count(*) * 100.0::DOUBLE, 2) AS missing_pct FROM long GROUP BY ALL) JOIN runs USING (station_id, parameter)""",
    )
)
def missing_profile(spark, d):
    return profile.missing_profile(clean_sparse(spark, d))


@cat.query(
    sql(
        SPARSE,
        body="""SELECT station_id, temperature IS NULL AS temperature_missing, pressure IS NULL AS pressure_missing,
  humidity IS NULL AS humidity_missing, count(*) AS rows,
  CASE CAST(temperature IS NULL AS INT) + CAST(pressure IS NULL AS INT) + CAST(humidity IS NULL AS INT)
    WHEN 0 THEN 'all_present' WHEN 3 THEN 'all_missing' ELSE 'some_missing' END AS kind
FROM sparse GROUP BY ALL""",
    )
)
def missing_patterns(spark, d):
    return profile.missing_patterns(clean_sparse(spark, d))


STATS = """SELECT station_id, parameter, count(v) AS count, coalesce(round(min(v), 2), 0) AS min,
  coalesce(round(max(v), 2), 0) AS max, coalesce(round(avg(v), 2), 0) AS mean,
  coalesce(round(stddev_samp(v), 2), 0) AS std, coalesce(round(quantile_cont(v, 0.25), 2), 0) AS q25,
  coalesce(round(quantile_cont(v, 0.5), 2), 0) AS median, coalesce(round(quantile_cont(v, 0.75), 2), 0) AS q75,
  coalesce(round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 2), 0) AS iqr FROM long GROUP BY ALL"""


@cat.query(sql(SPARSE, LONG.format("sparse"), body=STATS))
def parameter_statistics(spark, d):
    return profile.parameter_statistics(clean_sparse(spark, d))


@cat.query(
    sql(
        DENSE,
        LONG.format("dense"),
        body="""SELECT parameter, count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
  min(v) AS min, max(v) AS max, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50,
  quantile_cont(v, 0.75) AS p75 FROM long GROUP BY ALL""",
    )
)
def describe_channels(spark, d):
    out = profile.describe_channels(dense(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@cat.query(
    sql(
        SPARSE,
        body="""SELECT station_id, count(*) FILTER (temperature < -40) AS temperature_below,
  count(*) FILTER (temperature > 70) AS temperature_above, count(*) FILTER (pressure < 300) AS pressure_below,
  count(*) FILTER (pressure > 1250) AS pressure_above, count(*) FILTER (humidity < 0) AS humidity_below,
  count(*) FILTER (humidity > 100) AS humidity_above FROM sparse GROUP BY ALL""",
    )
)
def range_violation_counts(spark, d):
    return profile.range_violation_counts(clean_sparse(spark, d))


@cat.query(
    sql(
        DENSE,
        body="""SELECT station_id, "timestamp", temperature FROM dense
ORDER BY temperature DESC, station_id, "timestamp" LIMIT 10""",
    )
)
def extreme_events(spark, d):
    return profile.top_values(
        dense(spark, d).select("station_id", "timestamp", "temperature"), "temperature"
    )


@cat.query(
    sql(
        DENSE,
        """n AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY "timestamp") AS i FROM dense),
peak AS (SELECT station_id, i AS center FROM (SELECT *, row_number() OVER (
  PARTITION BY station_id ORDER BY temperature DESC, i) AS r FROM n) WHERE r = 1)""",
        body="""SELECT n.station_id, n."timestamp", n.temperature, CAST(i - center AS INTEGER) AS "offset"
FROM n JOIN peak USING (station_id) WHERE abs(i - center) <= 5""",
    )
)
def extreme_event_context(spark, d):
    out = profile.around_maximum(dense(spark, d), "temperature")
    return out.select("station_id", "timestamp", "temperature", "offset")


def _report(spark, d):
    raw = raw_rows(spark, d)
    null = F.lit(None).cast("double")
    clean = dedup_timestamps(raw, "event_id").withColumns({"pressure": null, "humidity": null})
    return profile.quality_report(raw, clean)


@cat.query(
    sql(
        RAW_ROWS,
        """clean AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (
    PARTITION BY station_id, "timestamp" ORDER BY event_id) AS rn FROM raw_rows) WHERE rn = 1),
steps AS (SELECT *, date_diff('microsecond', lag("timestamp") OVER (PARTITION BY station_id ORDER BY "timestamp"), "timestamp") / 3.6e9 AS h FROM clean)""",
        GAPS,
        """top AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY duration_hours DESC, gap_start) AS r FROM gaps)""",
        body="""SELECT a.*, raw_rows_n AS raw_rows, raw_rows_n - cleaned_rows AS duplicates, total_gaps, longest_gaps,
  median_gap_hours FROM (
  SELECT station_id, count(*) AS cleaned_rows, min("timestamp") AS date_start, max("timestamp") AS date_end,
    CAST(count(*) FILTER (h > 1) AS BIGINT) + 1 AS continuous_segments,
    round(quantile_cont(temperature, 0.5), 2) AS temperature_median FROM steps GROUP BY 1) a
JOIN (SELECT station_id, count(*) AS raw_rows_n FROM raw_rows GROUP BY 1) USING (station_id)
JOIN (SELECT station_id, count(*) AS total_gaps, quantile_cont(duration_hours, 0.5) AS median_gap_hours FROM gaps GROUP BY 1) USING (station_id)
JOIN (SELECT station_id, string_agg(CAST(gap_id AS VARCHAR), ',' ORDER BY r) AS longest_gaps FROM top WHERE r <= 10 GROUP BY 1) USING (station_id)""",
    )
)
def quality_report(spark, d):
    """Flattened fields of the nested report."""
    r = _report(spark, d)
    temperature = F.filter("parameter_statistics", lambda x: x["parameter"] == "temperature")[0]
    return r.select(
        "station_id",
        *[f"overview.{c}" for c in ("cleaned_rows", "date_start", "date_end", "continuous_segments", "raw_rows", "duplicates")],
        "time_gaps.total_gaps",
        "time_gaps.median_gap_hours",
        F.array_join(F.transform("longest_gaps", lambda g: g["gap_id"].cast("string")), ",").alias("longest_gaps"),
        temperature["median"].alias("temperature_median"),
    )


@cat.query()
def quality_report_markdown(spark, d):
    return profile.quality_report_markdown(_report(spark, d))


@cat.query(
    sql(
        *service_ctes("sparse"),
        body="""SELECT station_id, count(*) AS rows, count(*) FILTER (qc_flag = 'PASSED') AS flag_passed,
  count(*) FILTER (qc_flag = 'SUSPECT') AS flag_suspect, count(*) FILTER (qc_flag = 'MISSING') AS flag_missing,
  count(*) FILTER (qc_flag = 'GAP') AS flag_gap, count(*) FILTER (t_spike) AS temperature_spike,
  count(*) FILTER (p_spike) AS pressure_spike, count(*) FILTER (h_spike) AS humidity_spike,
  count(*) FILTER (t_flat) AS temperature_flatline, count(*) FILTER (p_flat) AS pressure_flatline,
  count(*) FILTER (h_flat) AS humidity_flatline, count(*) FILTER (missing_flag) AS missing_flag,
  count(*) FILTER (gap_flag) AS gap_flag FROM qc GROUP BY station_id""",
    )
)
def qc_summary(spark, d):
    return profile.qc_summary(quality_control(clean_sparse(spark, d)))


