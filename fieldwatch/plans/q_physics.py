"""Queries: moisture physics."""

from pyspark.sql import functions as F

from fieldwatch.functions import physics
from fieldwatch.plans.catalog import Catalog
from fieldwatch.plans.driver_views import clean_sparse, dense
from fieldwatch.plans.sqltext import DENSE, SPARSE, sql

cat = Catalog()
KEYS = ["station_id", "timestamp"]


def channels():
    return F.col("temperature"), F.col("pressure"), F.col("humidity")


MOIST = """moist AS (
  SELECT *, CASE WHEN temperature >= 0 THEN 6.112 * exp(17.67 * temperature / (temperature + 243.5))
    ELSE 6.112 * exp(21.875 * temperature / (temperature + 265.5)) END AS es,
    least(greatest(humidity, 1e-4), 100) AS rc FROM {0}),
dew AS (
  SELECT *, CASE WHEN humidity IS NULL OR temperature IS NULL THEN NULL WHEN temperature >= 0 THEN 243.5 * x / (17.67 - x) ELSE 265.5 * x / (21.875 - x) END AS td
  FROM (SELECT *, ln(greatest(es * (rc / 100), 1e-6) / 6.112) AS x FROM moist))"""


@cat.query(sql(DENSE, MOIST.format("dense"), body='SELECT station_id, "timestamp", round(es, 6) AS es FROM moist'))
def saturation_vapor_pressure(spark, d):
    t, p, rh = channels()
    return dense(spark, d).select(*KEYS, F.round(physics.saturation_vapor_pressure(t), 6).alias("es"))


@cat.query(
    sql(DENSE, MOIST.format("dense"), body='SELECT station_id, "timestamp", round(es * (humidity / 100), 6) AS e FROM moist')
)
def actual_vapor_pressure(spark, d):
    t, p, rh = channels()
    return dense(spark, d).select(*KEYS, F.round(physics.actual_vapor_pressure(t, rh), 6).alias("e"))


@cat.query(sql(SPARSE, MOIST.format("sparse"), body='SELECT station_id, "timestamp", round(td, 6) + 0 AS dew_point FROM dew'))
def dew_point(spark, d):
    t, p, rh = channels()
    return clean_sparse(spark, d).select(*KEYS, F.round(physics.dew_point(t, rh), 6).alias("dew_point"))


@cat.query(
    sql(SPARSE, MOIST.format("sparse"), body='SELECT station_id, "timestamp", round(temperature - td, 6) + 0 AS spread FROM dew')
)
def dew_point_spread(spark, d):
    t, p, rh = channels()
    return clean_sparse(spark, d).select(*KEYS, F.round(physics.dew_point_spread(t, rh), 6).alias("spread"))


@cat.query(
    sql(
        SPARSE,
        MOIST.format("sparse"),
        body="""SELECT station_id, "timestamp",
  CASE WHEN temperature IS NULL OR humidity IS NULL THEN 'UNAVAILABLE'
       WHEN humidity > 105 OR temperature - td < -0.5 OR temperature > 60 OR coalesce(pressure < 300 OR pressure > 1100, false) THEN 'FLAGGED' ELSE 'CLEAR' END AS status,
  CASE WHEN temperature IS NULL OR humidity IS NULL THEN 0.0::DOUBLE
       WHEN humidity > 105 OR temperature > 60 OR coalesce(pressure < 300 OR pressure > 1100, false) THEN 1.0::DOUBLE
       WHEN temperature - td < -0.5 THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS score,
  CASE WHEN temperature IS NULL OR humidity IS NULL THEN '' ELSE concat_ws('; ',
    CASE WHEN humidity > 105 THEN printf('Physical impossibility: Relative humidity (%.1f%%) exceeds saturation limit (105%%)', humidity) END,
    CASE WHEN temperature - td < -0.5 THEN printf('Thermodynamic violation: Dew point (%.1f°C) exceeds ambient temperature (%.1f°C)', td, temperature) END,
    CASE WHEN temperature > 60 THEN printf('Physical impossibility: Temperature (%.1f°C) outside terrestrial range limits', temperature) END,
    CASE WHEN pressure < 300 OR pressure > 1100 THEN printf('Physical impossibility: Pressure (%.1f hPa) outside surface barometric limits', pressure) END) END AS violations
FROM dew""",
    )
)
def thermo_consistency(spark, d):
    t, p, rh = channels()
    td = physics.dew_point(t, rh)
    score = physics.thermo_score(t, p, rh, td)
    known = t.isNotNull() & rh.isNotNull()
    text = F.when(known, F.concat_ws("; ", physics.thermo_violations(t, p, rh, td))).otherwise("")
    return clean_sparse(spark, d).select(
        *KEYS,
        physics.thermo_status(t, rh, score).alias("status"),
        score.alias("score"),
        text.alias("violations"),
    )


@cat.query(
    sql(
        SPARSE,
        MOIST.format("sparse"),
        body="""SELECT station_id, "timestamp",
  CASE WHEN td - 5 IS NULL OR temperature >= td - 5 + coalesce(pressure - 910, 0) / 10 THEN 'VALID' ELSE 'DEW_POINT_SUPERSATURATED' END AS label
FROM dew""",
    )
)
def dew_validity_label(spark, d):
    """A dew point shifted by the pressure stands in for a drifting humidity sensor."""
    t, p, rh = channels()
    td = physics.dew_point(t, rh) - 5 + F.coalesce(p - 910, F.lit(0.0)) / 10
    return clean_sparse(spark, d).select(*KEYS, physics.dew_validity(t, td).alias("label"))
