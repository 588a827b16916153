"""Queries: order, duplicates, gaps, segments, filling."""

from pyspark.sql import functions as F

from fieldwatch.config import CHANNELS
from fieldwatch.operators import structure
from fieldwatch.plans.catalog import Catalog
from fieldwatch.plans.driver_views import HOLED, clean_sparse, dense, holed, raw_rows
from fieldwatch.plans.sqltext import DENSE, RAW_ROWS, SPARSE, W, sql, steps

cat = Catalog()
KEYS = ["station_id", "timestamp"]


@cat.query(sql(SPARSE, body='SELECT station_id, "timestamp", temperature FROM sparse ORDER BY 1, 2'))
def sort_chronological(spark, d):
    return structure.sort_chronological(clean_sparse(spark, d)).select(*KEYS, "temperature")


@cat.query(
    sql(
        RAW_ROWS,
        body="""SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY station_id, "timestamp") AS copies
  FROM raw_rows) WHERE copies > 1""",
    )
)
def duplicate_audit(spark, d):
    return structure.duplicate_audit(raw_rows(spark, d))


@cat.query(
    sql(
        RAW_ROWS,
        body="""SELECT station_id, count(*) - count(DISTINCT "timestamp") AS duplicates
FROM raw_rows GROUP BY station_id""",
    )
)
def duplicate_count(spark, d):
    return structure.duplicate_count(raw_rows(spark, d))


def _dedup_sql(order):
    return sql(
        RAW_ROWS,
        body=f"""SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (
  PARTITION BY station_id, "timestamp" ORDER BY event_id {order}) AS rn FROM raw_rows) WHERE rn = 1""",
    )


@cat.query(_dedup_sql("ASC"))
def dedup_timestamps(spark, d):
    return structure.dedup_timestamps(raw_rows(spark, d), "event_id")


@cat.query(_dedup_sql("DESC"))
def dedup_timestamps_last(spark, d):
    return structure.dedup_timestamps(raw_rows(spark, d), "event_id", "last")


@cat.query(
    sql(
        RAW_ROWS,
        body="""SELECT * EXCLUDE n FROM (SELECT *, count(*) OVER (PARTITION BY station_id, "timestamp") AS n
  FROM raw_rows) WHERE n = 1""",
    )
)
def dedup_timestamps_none(spark, d):
    return structure.dedup_timestamps(raw_rows(spark, d), "event_id", "none")


GAPS = f"""placed AS (
  SELECT *, row_number() OVER w - 1 AS i, lag("timestamp") OVER w AS gap_start FROM steps {W}),
gaps AS (
  SELECT station_id, row_number() OVER (PARTITION BY station_id ORDER BY "timestamp") AS gap_id,
    i - 1 AS row_index_before, i AS row_index_after, gap_start, "timestamp" AS gap_end,
    round(h, 2) AS duration_hours, round_even(round(h, 2) / 24, 2) AS duration_days,
    CAST(round_even(round(h, 2), 0) AS BIGINT) - 1 AS missing_steps FROM placed WHERE h > 1)"""


@cat.query(sql(SPARSE, steps("sparse"), GAPS, body="SELECT * FROM gaps"))
def time_gaps(spark, d):
    return structure.time_gaps(clean_sparse(spark, d))


@cat.query(
    sql(
        SPARSE,
        steps("sparse"),
        GAPS,
        body="""SELECT s.station_id, coalesce(total_gaps, 0) AS total_gaps, coalesce(a, 0.0::DOUBLE) AS min_gap_hours,
  coalesce(b, 0.0::DOUBLE) AS max_gap_hours, coalesce(c, 0.0::DOUBLE) AS mean_gap_hours, coalesce(e, 0.0::DOUBLE) AS median_gap_hours,
  coalesce(f, 0.0::DOUBLE) AS p90_gap_hours, coalesce(g, 0.0::DOUBLE) AS total_missing_hours
FROM (SELECT DISTINCT station_id FROM sparse) s LEFT JOIN (
  SELECT station_id, count(*) AS total_gaps, min(duration_hours) AS a, max(duration_hours) AS b,
    round(avg(duration_hours), 2) AS c, quantile_cont(duration_hours, 0.5) AS e,
    round(quantile_cont(duration_hours, 0.9), 2) AS f, round(sum(duration_hours) - count(*), 1) AS g
  FROM gaps GROUP BY 1) t USING (station_id)""",
    )
)
def gap_statistics(spark, d):
    return structure.gap_statistics(clean_sparse(spark, d))


@cat.query(
    sql(
        SPARSE,
        steps("sparse"),
        GAPS,
        body="""SELECT * FROM (SELECT *, CAST(row_number() OVER (
  PARTITION BY station_id ORDER BY duration_hours DESC, gap_start) AS INTEGER) AS rank FROM gaps) WHERE rank <= 10""",
    )
)
def top_gaps(spark, d):
    return structure.top_gaps(clean_sparse(spark, d))


@cat.query(
    sql(
        SPARSE,
        steps("sparse"),
        body=f"""SELECT station_id, "timestamp",
  CAST(sum(CASE WHEN h > 1 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS segment_id FROM steps {W}""",
    )
)
def segment_ids(spark, d):
    return structure.segment_ids(clean_sparse(spark, d)).select(*KEYS, "segment_id")


@cat.query(
    sql(
        SPARSE,
        steps("sparse"),
        body=f"""SELECT station_id, "timestamp",
  CAST(sum(CASE WHEN h = 1 THEN 0 ELSE 1 END) OVER w AS BIGINT) AS segment_id FROM steps {W}""",
    )
)
def segment_ids_strict(spark, d):
    return structure.segment_ids_strict(clean_sparse(spark, d)).select(*KEYS, "segment_id")


COMPLETE = f"""opened AS (
  SELECT *, CAST(sum(CASE WHEN h = 1 AND temperature IS NOT NULL AND pressure IS NOT NULL
    AND humidity IS NOT NULL THEN 0 ELSE 1 END) OVER w AS BIGINT) AS segment_id FROM steps {W}),
complete AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY station_id, segment_id) AS n FROM opened) WHERE n >= 24)"""


@cat.query(
    sql(
        HOLED,
        steps("holed"),
        COMPLETE,
        body='SELECT station_id, "timestamp", temperature, pressure, humidity, segment_id FROM complete',
    )
)
def complete_segments(spark, d):
    return structure.complete_segments(holed(spark, d))


@cat.query(
    sql(
        HOLED,
        steps("holed"),
        COMPLETE,
        body="""SELECT * FROM (SELECT station_id, segment_id, count(*) AS rows, min("timestamp") AS "start",
    max("timestamp") AS "end", CAST(row_number() OVER (PARTITION BY station_id ORDER BY count(*) DESC, min("timestamp")) AS INTEGER) AS rank,
    count(*) OVER (PARTITION BY station_id) AS segments,
    CAST(sum(count(*)) OVER (PARTITION BY station_id) AS BIGINT) AS eligible_rows
  FROM complete GROUP BY station_id, segment_id) WHERE rank <= 10""",
    )
)
def segment_catalog(spark, d):
    return structure.segment_catalog(structure.complete_segments(holed(spark, d)))


def _fill_sql(strict: bool) -> str:
    """For each channel: distance to the previous and next value, then the linear fill."""
    parts, outs, marks = [], [], []
    for c in CHANNELS:
        parts.append(
            f"""last_value(CASE WHEN {c} IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS {c}_pi,
    last_value({c} IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS {c}_pv,
    last_value(CASE WHEN {c} IS NOT NULL THEN "timestamp" END IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS {c}_pt,
    first_value(CASE WHEN {c} IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {c}_ni,
    first_value({c} IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {c}_nv,
    first_value(CASE WHEN {c} IS NOT NULL THEN "timestamp" END IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {c}_nt"""
        )
        ok = f"{c} IS NULL AND {c}_pi IS NOT NULL AND i - {c}_pi <= 2"
        if strict:
            ok += (
                f" AND coalesce({c}_ni - {c}_pi - 1 <= 2 AND date_diff('microsecond', {c}_pt, {c}_nt) / 3.6e9 <= {c}_ni - {c}_pi, false)"
            )
        marks.append(f"({ok})")
        outs.append(
            f"""round(CASE WHEN {ok} THEN CASE WHEN {c}_ni IS NULL THEN {c}_pv
    ELSE {c}_pv + ({c}_nv - {c}_pv) * (i - {c}_pi) / ({c}_ni - {c}_pi) END ELSE {c} END, 6) AS {c}"""
        )
    return sql(
        HOLED,
        'numbered AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY "timestamp") AS i FROM holed)',
        "near AS (SELECT *, " + ", ".join(parts) + " FROM numbered)",
        body='SELECT station_id, "timestamp", ' + ", ".join(outs) + ", " + " OR ".join(marks) + " AS is_interpolated FROM near",
    )


def _rounded(df):
    return df.select(*KEYS, *[F.round(c, 6).alias(c) for c in CHANNELS], "is_interpolated")


@cat.query(_fill_sql(False))
def interpolate_small_gaps(spark, d):
    return _rounded(structure.interpolate_small_gaps(holed(spark, d)))


@cat.query(_fill_sql(True))
def interpolate_small_gaps_strict(spark, d):
    return _rounded(structure.interpolate_small_gaps(holed(spark, d), mode="strict"))


RUNS = """long AS (
  SELECT station_id, "timestamp", 'temperature' AS parameter, temperature AS v FROM sparse UNION ALL
  SELECT station_id, "timestamp", 'pressure', pressure FROM sparse UNION ALL
  SELECT station_id, "timestamp", 'humidity', humidity FROM sparse),
islands AS (
  SELECT *, count(v) OVER (PARTITION BY station_id, parameter ORDER BY "timestamp") AS g FROM long),
runs AS (
  SELECT station_id, parameter, max(n) AS max_consecutive_missing FROM (
    SELECT station_id, parameter, g, count(*) FILTER (v IS NULL) AS n FROM islands GROUP BY ALL) GROUP BY ALL)"""


@cat.query(sql(SPARSE, RUNS, body="SELECT * FROM runs"))
def max_missing_run(spark, d):
    return structure.missing_runs(clean_sparse(spark, d))


@cat.query(
    sql(
        SPARSE,
        steps("sparse"),
        body="""SELECT * FROM (SELECT *, CAST(row_number() OVER (
    PARTITION BY station_id ORDER BY n DESC, step_hours) AS INTEGER) AS rank FROM (
    SELECT station_id, h AS step_hours, count(*) AS n FROM steps WHERE h IS NOT NULL GROUP BY ALL))
  JOIN (SELECT station_id, max(h) AS max_step_hours, quantile_cont(h, 0.5) AS median_step_hours
    FROM steps GROUP BY 1) USING (station_id) WHERE rank <= 10""",
    )
)
def interval_distribution(spark, d):
    return structure.interval_distribution(clean_sparse(spark, d))


@cat.query(
    sql(
        DENSE,
        body="""SELECT station_id, "timestamp", temperature, min(temperature) OVER (PARTITION BY station_id) AS min_temperature,
  max(temperature) OVER (PARTITION BY station_id) AS max_temperature FROM (
  SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY "timestamp" DESC) AS rn FROM dense) WHERE rn <= 24""",
    )
)
def latest_trend(spark, d):
    out = structure.latest_trend(dense(spark, d))
    return out.select(*KEYS, "temperature", "min_temperature", "max_temperature")
