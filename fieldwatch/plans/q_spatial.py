"""Queries: neighbouring stations, coverage."""

from pyspark.sql import functions as F

from fieldwatch.config import CHANNELS
from fieldwatch.functions.geo import haversine_km, pressure_at
from fieldwatch.operators import spatial
from fieldwatch.plans.catalog import Catalog
from fieldwatch.plans.driver_views import dense, stations, table
from fieldwatch.plans.sqltext import DENSE, STATIONS, sql

cat = Catalog()
KEYS = ["station_id", "timestamp"]


def hav(a, b):
    """Great-circle km between rows a and b, as SQL."""
    x = f"(pow(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2))"
    return f"round(6371.0::DOUBLE * 2 * atan2(sqrt({x}), sqrt(1 - {x})), 2)"


def neighbours(dim):
    return dim.select(
        "station_id",
        F.posexplode(F.array_distinct(F.array("neighbour_1", "neighbour_2"))).alias("preference", "neighbour_id"),
    )


NEIGHBOURS = """neigh AS (
  SELECT station_id, neighbour_1 AS neighbour_id, 0 AS preference FROM stations WHERE neighbour_1 <> station_id
  UNION ALL SELECT station_id, neighbour_2, 1 FROM stations WHERE neighbour_2 <> station_id AND neighbour_2 <> neighbour_1)"""
DIST = f"""dist AS (SELECT n.*, a.elevation_m, b.station_name AS neighbour_name, b.elevation_m AS neighbour_elevation_m, {hav('a', 'b')} AS distance_km
  FROM neigh n JOIN stations a ON a.station_id = n.station_id JOIN stations b ON b.station_id = n.neighbour_id)"""


@cat.query(
    sql(
        "p AS (SELECT s_suppkey, s_acctbal / 200 AS latitude, s_nationkey * 7.0::DOUBLE AS longitude FROM supplier)",
        "o AS (SELECT 10.5::DOUBLE AS latitude, -20.25::DOUBLE AS longitude)",
        body=f"SELECT s_suppkey, {hav('p', 'o')} AS km FROM p, o",
    )
)
def haversine_km_query(spark, d):
    s = table(spark, d, "supplier")
    km = haversine_km(F.col("s_acctbal") / 200, F.col("s_nationkey") * 7.0, F.lit(10.5), F.lit(-20.25))
    return s.select("s_suppkey", km.alias("km"))


cat.queries["haversine_km"] = cat.queries.pop("haversine_km_query")
cat.sql["haversine_km"] = cat.sql.pop("haversine_km_query")


@cat.query(sql(STATIONS, NEIGHBOURS, DIST, body="SELECT station_id, neighbour_id, distance_km FROM dist"))
def station_distances(spark, d):
    dim = stations(spark, d)
    return spatial.station_distances(dim, neighbours(dim)).select("station_id", "neighbour_id", "distance_km")


@cat.query(
    sql(
        DENSE,
        STATIONS,
        body="""SELECT station_id, "timestamp", round(pressure - (250.0::DOUBLE - elevation_m) / 8.4::DOUBLE, 6) AS at_250m
FROM dense JOIN stations USING (station_id)""",
    )
)
def elevation_pressure_adjust(spark, d):
    rows = dense(spark, d).join(stations(spark, d).select("station_id", "elevation_m"), "station_id")
    moved = pressure_at(F.col("pressure"), F.col("elevation_m"), F.lit(250.0))
    return rows.select(*KEYS, F.round(moved, 6).alias("at_250m"))


READINGS = """readings AS (
  SELECT o.station_id, o."timestamp", CASE WHEN n.pressure > 950 THEN 'UNKNOWN' ELSE n.station_id END AS given_id,
    CASE WHEN n.humidity >= 60 THEN NULL ELSE n.temperature END AS bt,
    CASE WHEN n.humidity >= 50 THEN NULL ELSE n.pressure END AS bp,
    CASE WHEN n.humidity >= 60 THEN NULL ELSE n.humidity END AS bh
  FROM dense o JOIN stations s USING (station_id) JOIN dense n ON n.station_id = s.neighbour_1 AND n."timestamp" = o."timestamp"
  WHERE n.temperature < -8),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY preference) AS r FROM dist) WHERE r = 1),
buddy AS (
  SELECT o.station_id, o."timestamp", o.temperature, o.pressure, o.humidity, r.station_id IS NOT NULL AS given,
    CASE WHEN r.station_id IS NOT NULL THEN coalesce(x.neighbour_id, f.neighbour_id) END AS buddy_station_id,
    coalesce(x.neighbour_name, f.neighbour_name) AS nm, coalesce(x.distance_km, f.distance_km) AS km,
    coalesce(x.elevation_m, f.elevation_m) AS ea, coalesce(x.neighbour_elevation_m, f.neighbour_elevation_m) AS eb, bt, bp, bh
  FROM dense o LEFT JOIN readings r USING (station_id, "timestamp") LEFT JOIN firsts f ON f.station_id = o.station_id
  LEFT JOIN dist x ON x.station_id = o.station_id AND x.neighbour_id = r.given_id),
diffs AS (SELECT *, round(temperature - bt, 2) AS dt, pressure - (eb - ea) / 8.4::DOUBLE AS moved,
  round(pressure - (eb - ea) / 8.4::DOUBLE - bp, 2) AS dp, round(humidity - bh, 2) AS dh,
  given AND NOT (bt IS NULL AND bp IS NULL AND bh IS NULL) AS usable FROM buddy),
spat AS (SELECT *, coalesce(abs(dt) > 6, false) AS toff, coalesce(abs(dp) > 4, false) AS poff, coalesce(abs(dh) > 25, false) AS hoff FROM diffs),
spatial AS (SELECT *, CASE WHEN usable THEN NOT (toff OR poff) END AS spatial_agreement,
  CASE WHEN NOT usable THEN 0.0::DOUBLE WHEN (toff OR poff) AND coalesce(abs(dt) > 20, false) THEN -1.0::DOUBLE WHEN toff OR poff THEN -0.7::DOUBLE ELSE 0.8::DOUBLE END AS spatial_score,
  CASE WHEN NOT usable THEN 'UNAVAILABLE' WHEN toff OR poff THEN 'ISOLATED_DISCORDANCE' ELSE 'NORMAL_CONSISTENT' END AS spatial_status FROM spat)"""


def readings_of(spark, d):
    obs, dim = dense(spark, d), stations(spark, d)
    near = obs.select(
        F.col("station_id").alias("n_id"),
        "timestamp",
        *[F.col(c).alias(f"n_{c}") for c in CHANNELS],
    ).where("n_temperature < -8")
    h = F.col("n_humidity")
    return (
        obs.select(*KEYS)
        .join(dim.select("station_id", F.col("neighbour_1").alias("n_id")), "station_id")
        .join(near, ["n_id", "timestamp"])
        .select(
            *KEYS,
            F.when(F.col("n_pressure") > 950, "UNKNOWN").otherwise(F.col("n_id")).alias("buddy_station_id"),
            F.when(h < 60, F.col("n_temperature")).alias("buddy_temperature"),
            F.when(h < 50, F.col("n_pressure")).alias("buddy_pressure"),
            F.when(h < 60, h).alias("buddy_humidity"),
        )
    )


def joined(spark, d, obs=None):
    dim = stations(spark, d)
    pairs = spatial.station_distances(dim, neighbours(dim))
    obs = dense(spark, d).drop("station_no") if obs is None else obs
    return spatial.buddy_join(obs, readings_of(spark, d), pairs)


SPATIAL_CTES = [DENSE, STATIONS, NEIGHBOURS, DIST, READINGS]


@cat.query(
    sql(
        *SPATIAL_CTES,
        body="""SELECT station_id, "timestamp", given AS buddy_given, buddy_station_id, CASE WHEN given THEN km END AS buddy_distance_km,
  bt AS buddy_temperature, bp AS buddy_pressure, bh AS buddy_humidity FROM buddy""",
    )
)
def buddy_join(spark, d):
    return joined(spark, d).select(
        *KEYS, "buddy_given", "buddy_station_id", "buddy_distance_km", *[f"buddy_{c}" for c in CHANNELS]
    )


@cat.query(
    sql(
        *SPATIAL_CTES,
        body="""SELECT station_id, "timestamp", CASE WHEN usable THEN dt END AS temp_difference,
  CASE WHEN usable THEN dp END AS pressure_difference_adjusted, CASE WHEN usable THEN dh END AS humidity_difference,
  spatial_agreement, spatial_score, spatial_status,
  CASE WHEN NOT given THEN 'Spatial validation unavailable: No neighboring station observations provided.'
       WHEN NOT usable THEN 'Neighboring station ' || nm || ' data is missing or empty.'
       ELSE concat_ws(' / ',
         CASE WHEN toff THEN printf('Spatial discordance: Target temp %.1f°C diverges from %s (%.1f°C) by %.1f°C (> 6.0°C tolerance)', temperature, nm, bt, dt) END,
         CASE WHEN poff THEN printf('Spatial discordance: Adjusted pressure %.1f hPa differs from %s (%.1f hPa) by %.1f hPa', moved, nm, bp, dp) END,
         CASE WHEN hoff THEN printf('Spatial discordance: Relative humidity %.1f%% differs from %s (%.1f%%) by %.1f%%', humidity, nm, bh, dh) END) END AS reasons
FROM spatial""",
    )
)
def spatial_check(spark, d):
    out = spatial.spatial_check(joined(spark, d))
    return out.select(
        *KEYS,
        "temp_difference",
        "pressure_difference_adjusted",
        "humidity_difference",
        "spatial_agreement",
        "spatial_score",
        "spatial_status",
        F.concat_ws(" / ", "spatial_reasons").alias("reasons"),
    )


@cat.query(
    """SELECT r_name, count(*) AS stations, round(least(0.95::DOUBLE, 0.25::DOUBLE + count(*) / max(count(*)) OVER () * 0.7::DOUBLE), 6) AS intensity
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"""
)
def coverage_ranking(spark, d):
    where = (
        table(spark, d, "supplier")
        .join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumnRenamed("s_suppkey", "station_id")
    )
    out = spatial.coverage_ranking(where, "r_name")
    return out.withColumn("intensity", F.round("intensity", 6))
