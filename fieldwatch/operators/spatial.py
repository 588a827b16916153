"""Comparison with neighbouring stations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldwatch.config import CHANNELS
from fieldwatch.functions.text import compact_texts, round_even
from fieldwatch.functions.geo import haversine_km, pressure_at
from fieldwatch.session import row_sized

TOLERANCE = {"temperature": 6.0, "pressure": 4.0, "humidity": 25.0}

# Texts of the unavailable cases.
NO_READING = "Spatial validation unavailable: No neighboring station observations provided."


def station_distances(stations: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Registered neighbour pairs (station_id, neighbour_id, preference) with names,
    elevations and distance; a station is not its own neighbour."""
    here = stations.select(
        "station_id",
        F.col("latitude").alias("_la"),
        F.col("longitude").alias("_lo"),
        F.col("elevation_m").alias("elevation_m"),
    )
    there = stations.select(
        F.col("station_id").alias("neighbour_id"),
        F.col("station_name").alias("neighbour_name"),
        F.col("latitude").alias("_lb"),
        F.col("longitude").alias("_lp"),
        F.col("elevation_m").alias("neighbour_elevation_m"),
    )
    pairs = neighbours.where(F.col("station_id") != F.col("neighbour_id"))
    return (
        pairs.join(here, "station_id")
        .join(there, "neighbour_id")
        .withColumn("distance_km", haversine_km(F.col("_la"), F.col("_lo"), F.col("_lb"), F.col("_lp")))
        .drop("_la", "_lo", "_lb", "_lp")
    )


def buddy_join(obs: DataFrame, readings: DataFrame, distances: DataFrame) -> DataFrame:
    """Each observation with the neighbour reading given for it, if any.

    readings: (station_id, timestamp, buddy_station_id, buddy_temperature, buddy_pressure,
    buddy_humidity).  An id that is not a registered neighbour means the preferred one.
    """
    first = (
        distances.withColumn(
            "_r", F.row_number().over(Window.partitionBy("station_id").orderBy("preference"))
        )
        .where("_r = 1")
        .drop("_r", "preference")
    )
    meta = ["neighbour_id", "neighbour_name", "distance_km", "elevation_m", "neighbour_elevation_m"]
    default = first.select("station_id", F.struct(*meta).alias("_default"))
    named = distances.select("station_id", F.col("neighbour_id").alias("_nid"), F.struct(*meta).alias("_named"))
    joined = (
        obs.join(row_sized(readings.withColumn("_given", F.lit(True))), ["station_id", "timestamp"], "left")
        .join(default, "station_id", "left")
        .join(
            named.withColumnRenamed("station_id", "_sid"),
            (F.col("station_id") == F.col("_sid")) & (F.col("buddy_station_id") == F.col("_nid")),
            "left",
        )
    )
    buddy = F.when(F.col("_given"), F.coalesce("_named", "_default"))
    return joined.select(
        *obs.columns,
        F.coalesce("_given", F.lit(False)).alias("buddy_given"),
        buddy["neighbour_id"].alias("buddy_station_id"),
        buddy["neighbour_name"].alias("buddy_name"),
        buddy["distance_km"].alias("buddy_distance_km"),
        buddy["elevation_m"].alias("elevation_m"),
        buddy["neighbour_elevation_m"].alias("buddy_elevation_m"),
        *[f"buddy_{c}" for c in CHANNELS],
    )


def spatial_check(joined: DataFrame) -> DataFrame:
    """Differences, agreement, score, status and reasons.  Humidity is reported, it never
    decides."""
    t, p, h = (F.col(c) for c in CHANNELS)
    bt, bp, bh = (F.col(f"buddy_{c}") for c in CHANNELS)
    moved = pressure_at(p, F.col("elevation_m"), F.col("buddy_elevation_m"))
    # Named first: each is used many times below.
    differences = {"_dt": round_even(t - bt, 2), "_dp": round_even(moved - bp, 2), "_dh": round_even(h - bh, 2)}
    columns = joined.columns
    joined = joined.withColumns(differences)
    dt, dp, dh = (F.col(c) for c in differences)
    empty = bt.isNull() & bp.isNull() & bh.isNull()
    usable = F.col("buddy_given") & ~empty
    t_off = F.coalesce(F.abs(dt) > TOLERANCE["temperature"], F.lit(False))
    p_off = F.coalesce(F.abs(dp) > TOLERANCE["pressure"], F.lit(False))
    h_off = F.coalesce(F.abs(dh) > TOLERANCE["humidity"], F.lit(False))
    off = t_off | p_off
    name = F.col("buddy_name")
    reasons = compact_texts(
        F.when(
            t_off,
            F.format_string(
                "Spatial discordance: Target temp %.1f°C diverges from %s (%.1f°C) by %.1f°C (> 6.0°C tolerance)",
                t, name, bt, dt,
            ),
        ),
        F.when(
            p_off,
            F.format_string(
                "Spatial discordance: Adjusted pressure %.1f hPa differs from %s (%.1f hPa) by %.1f hPa",
                moved, name, bp, dp,
            ),
        ),
        F.when(
            h_off,
            F.format_string(
                "Spatial discordance: Relative humidity %.1f%% differs from %s (%.1f%%) by %.1f%%",
                h, name, bh, dh,
            ),
        ),
    )
    return joined.select(
        *[c for c in columns if c not in ("buddy_given", "elevation_m", "buddy_elevation_m")],
        F.when(usable, dt).alias("temp_difference"),
        F.when(usable, dp).alias("pressure_difference_adjusted"),
        F.when(usable, dh).alias("humidity_difference"),
        F.when(usable, ~off).alias("spatial_agreement"),
        F.when(~usable, 0.0)
        .when(off & (F.abs(dt) > 20.0), -1.0)
        .when(off, -0.7)
        .otherwise(0.8)
        .alias("spatial_score"),
        F.when(~usable, "UNAVAILABLE")
        .when(off, "ISOLATED_DISCORDANCE")
        .otherwise("NORMAL_CONSISTENT")
        .alias("spatial_status"),
        F.when(~F.col("buddy_given"), F.array(F.lit(NO_READING)))
        .when(
            empty,
            F.array(F.concat(F.lit("Neighboring station "), name, F.lit(" data is missing or empty."))),
        )
        .otherwise(reasons)
        .alias("spatial_reasons"),
    )


def coverage_ranking(stations: DataFrame, region: str) -> DataFrame:
    """Stations per region, most first, with a display intensity; regions without one drop out."""
    counts = stations.groupBy(region).agg(F.count("station_id").alias("stations"))
    counts = counts.where("stations > 0")
    top = counts.agg(F.max("stations").alias("_top"))
    share = F.lit(0.25) + F.col("stations") / F.col("_top") * 0.7
    return (
        counts.crossJoin(F.broadcast(top))  # one row
        .withColumn("intensity", F.least(F.lit(0.95), share))
        .drop("_top")
        .orderBy(F.desc("stations"), region)
    )
