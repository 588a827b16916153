"""Queries: rule checks of the service profile."""

from pyspark.sql import functions as F

from fieldwatch.operators import qc
from fieldwatch.plans.catalog import Catalog
from fieldwatch.plans.driver_views import clean_sparse, dense
from fieldwatch.plans.sqltext import DENSE, QC_COLUMNS, SPARSE, flat_runs, service_ctes, sql, steps

cat = Catalog()
KEYS = ["station_id", "timestamp"]


def flat_text(df):
    """Reason lists as one text, so both engines compare the same value."""
    return df.withColumn("reasons", F.concat_ws("; ", "qc_reasons")).drop("qc_reasons")


@cat.query(sql(*service_ctes("sparse"), body=f"SELECT {QC_COLUMNS} FROM qc"))
def qc_full(spark, d):
    return flat_text(qc.quality_control(clean_sparse(spark, d)))


@cat.query(sql(*service_ctes("dense"), body=f"SELECT {QC_COLUMNS} FROM qc"))
def qc_full_dense(spark, d):
    return flat_text(qc.quality_control(dense(spark, d)))


@cat.query(
    sql(
        *service_ctes("sparse"),
        body="""SELECT station_id, "timestamp", t_bad AS temperature_implausible,
  p_bad AS pressure_implausible, h_bad AS humidity_implausible,
  CASE WHEN temperature < -60 THEN printf('temperature_plausibility_violation: %.2f < -60.00', temperature)
       WHEN temperature > 25 THEN printf('temperature_plausibility_violation: %.2f > 25.00', temperature) END AS temperature_range_reason,
  CASE WHEN pressure < 850 THEN printf('pressure_plausibility_violation: %.2f < 850.00', pressure)
       WHEN pressure > 1080 THEN printf('pressure_plausibility_violation: %.2f > 1080.00', pressure) END AS pressure_range_reason,
  CASE WHEN humidity < 2 THEN printf('humidity_plausibility_violation: %.2f < 2.00', humidity)
       WHEN humidity > 100 THEN printf('humidity_plausibility_violation: %.2f > 100.00', humidity) END AS humidity_range_reason
FROM qc""",
    )
)
def qc_plausibility(spark, d):
    out = qc.plausibility(clean_sparse(spark, d))
    return out.select(*KEYS, *[c for c in out.columns if c.endswith(("_implausible", "_range_reason"))])


@cat.query(
    sql(
        *service_ctes("sparse"),
        body="""SELECT station_id, "timestamp", round(t_rate, 3) AS temperature_rate,
  round(p_rate, 3) AS pressure_rate, round(h_rate, 3) AS humidity_rate,
  t_spike AS temperature_spike, p_spike AS pressure_spike, h_spike AS humidity_spike FROM qc""",
    )
)
def qc_rate_of_change(spark, d):
    out = qc.rate_of_change(clean_sparse(spark, d))
    return out.select(*KEYS, *[c for c in out.columns if c.endswith(("_rate", "_spike"))])


@cat.query(
    sql(
        DENSE,
        steps("dense"),
        flat_runs("steps", "flat", 4, "1e-4", 1.5),
        body="""SELECT station_id, "timestamp", t_flat AS temperature_flatline,
  p_flat AS pressure_flatline, h_flat AS humidity_flatline FROM flat""",
    )
)
def qc_flatline(spark, d):
    out = qc.flatline(dense(spark, d))
    return out.select(*KEYS, *[c for c in out.columns if c.endswith("_flatline")])


@cat.query(
    sql(
        SPARSE,
        body="""SELECT station_id, "timestamp",
  temperature IS NULL OR pressure IS NULL OR humidity IS NULL AS missing_flag,
  concat_ws(',', CASE WHEN temperature IS NULL THEN 'temperature_missing' END,
    CASE WHEN pressure IS NULL THEN 'pressure_missing' END,
    CASE WHEN humidity IS NULL THEN 'humidity_missing' END) AS channels FROM sparse""",
    )
)
def qc_missing(spark, d):
    out = qc.missing(clean_sparse(spark, d))
    return out.select(*KEYS, "missing_flag", F.concat_ws(",", "missing_channels").alias("channels"))


@cat.query(
    sql(
        SPARSE,
        steps("sparse"),
        body="""SELECT station_id, "timestamp", round(h, 6) AS hours_since_previous,
  coalesce(h > 1, false) AS gap_flag FROM steps""",
    )
)
def qc_time_gap(spark, d):
    out = qc.time_gap(clean_sparse(spark, d))
    return out.select(
        *KEYS, F.round("hours_since_previous", 6).alias("hours_since_previous"), "gap_flag"
    )


@cat.query(
    sql(
        *service_ctes("sparse"),
        body="SELECT station_id, qc_flag, count(*) AS n FROM qc GROUP BY ALL",
    )
)
def qc_flag(spark, d):
    out = qc.quality_control(clean_sparse(spark, d))
    return out.groupBy("station_id", "qc_flag").agg(F.count(F.lit(1)).alias("n"))


@cat.query(
    sql(
        *service_ctes("sparse"),
        body="""SELECT reason, count(*) AS n FROM (
  SELECT split_part(unnest(string_split(reasons, '; ')), ':', 1) AS reason FROM qc WHERE reasons <> '')
GROUP BY reason""",
    )
)
def qc_reasons(spark, d):
    out = qc.quality_control(clean_sparse(spark, d))
    return (
        out.select(F.explode("qc_reasons").alias("r"))
        .select(F.split_part("r", F.lit(":"), F.lit(1)).alias("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@cat.query(
    sql(
        SPARSE,
        steps("sparse"),
        body="""SELECT station_id, "timestamp",
  coalesce(temperature > CASE WHEN station_id = 'ST-1' THEN -25.0 ELSE 25.0 END OR temperature < -60, false)
   OR coalesce(pressure < 850 OR pressure > 1080, false) OR coalesce(humidity < 2 OR humidity > 100, false)
   OR coalesce(CASE WHEN h > 0 AND h <= 1.5 THEN abs(temperature - pt) / h END > 8, false)
   OR coalesce(CASE WHEN h > 0 AND h <= 1.5 THEN abs(pressure - pp) / h END > CASE WHEN station_id = 'ST-0' THEN 2.0 ELSE 6.0 END, false)
   OR coalesce(CASE WHEN h > 0 AND h <= 1.5 THEN abs(humidity - ph) / h END > 30, false) AS suspect
FROM steps""",
    )
)
def qc_config_join(spark, d):
    """Limits per station: ST-1 has a lower temperature limit, ST-0 a lower pressure rate."""
    limits = spark.createDataFrame(
        [("ST-1", -25.0, None), ("ST-0", None, 2.0)],
        "station_id string, temperature_max double, pressure_rate_max double",
    )
    out = qc.quality_control(clean_sparse(spark, d), thresholds=limits)
    # Runs of equal readings do not occur in this view, so SUSPECT means range or rate.
    return out.select(*KEYS, (F.col("qc_flag") == "SUSPECT").alias("suspect"))
