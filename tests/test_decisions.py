import numpy as np
from helpers import series
from pyspark.sql import functions as F

from fieldwatch import decisions
from fieldwatch.operators import alerts
from fieldwatch.session import BLOCK_ROWS, work_path


def observations(spark, hours=160):
    draw = np.random.default_rng(3)
    rows = []
    for h in range(hours):
        day = np.sin(h / 24 * 2 * np.pi)
        rows.append([h, float(np.round(-15 + 4 * day + draw.normal(0, 0.3), 2)), float(np.round(980 + draw.normal(0, 0.4), 2)), float(np.round(60 - 8 * day + draw.normal(0, 1), 2))])
    rows[140][1], rows[140][3] = 41.6, 100.0
    rows[150][1:] = [None, None, None]
    return series(spark, rows)


def test_batch_job_feeds_decisions_and_log(spark):
    block = spark.conf.get(BLOCK_ROWS)
    spark.conf.set(BLOCK_ROWS, "100")
    try:
        obs = observations(spark)
        near = [F.lit("N").alias("buddy_station_id"), F.lit(-15.0).alias("buddy_temperature"), F.lit(980.0).alias("buddy_pressure"), F.lit(60.0).alias("buddy_humidity")]
        readings = obs.select("station_id", "timestamp", *near)
        pairs = spark.createDataFrame(
            [("A", "N", "Near", 3.0, 100.0, 100.0, 1)],
            "station_id string, neighbour_id string, neighbour_name string, distance_km double, elevation_m double, neighbour_elevation_m double, preference int",
        )
        out = decisions.run_decisions(obs, readings, pairs, decisions.Settings(trees=20))
        rows = {r.timestamp: r for r in out.collect()}
        assert len(rows) == obs.count()
        times = sorted(rows)
        bad, gone = rows[times[140]], rows[times[150]]
        assert bad.classification == "LIKELY_SENSOR_DATA_FAULT" and bad.severity == "CRITICAL"
        assert bad.iforest_status == "FLAGGED" and bad.sequence_status == "FLAGGED" and bad.spatial_status == "ISOLATED_DISCORDANCE"
        before, after = rows[times[139]].temperature, rows[times[141]].temperature
        assert bad.observed_value == 41.6 and abs(bad.estimated_value - (before + after) / 2) < 1e-9
        assert gone.classification == "UNCERTAIN" and gone.estimated_value is None
        assert all(r.overall_health_index is not None for r in rows.values())
        path = work_path(spark, "log")
        for _ in range(2):
            decisions.update_log(spark, out, path, "now")
        log = alerts.read_log(spark, path).collect()
        assert len(log) == len({r.alert_key for r in log}) == sum(r.classification != "NORMAL" for r in rows.values())
        assert sum(r.alerts for r in alerts.severity_counts(alerts.read_log(spark, path)).collect()) >= 2
    finally:
        spark.conf.set(BLOCK_ROWS, block)


def test_cleaning_in_one_call(spark):
    raw = spark.createDataFrame(
        [
            ("A", "1/1/2015 0:00", -10.5, 985.2, 15.0, 180.0, 60.0, 1),
            ("A", "2015-01-01T00:00:00Z", -9.0, 985.2, 15.0, 180.0, 61.0, 2),
            ("A", "1/1/2015 1:00 PM", -999.0, 984.8, 18.0, 190.0, 65.0, 3),
            ("A", "2015-01-01 20:00:00.5+02:00", -1.0, 984.8, 18.0, 190.0, 65.0, 4),
            ("A", "never", -1.0, 984.8, 18.0, 190.0, 65.0, 5),
        ],
        "station_id string, TimeStamp string, `Air Temperature` double, `Air Pressure` double, `Wind Speed` double, `Wind Direction` double, `Relative Humidity` double, seq int",
    )
    got = [(str(r.timestamp), r.temperature, r.humidity) for r in decisions.clean_observations(raw, order="seq").orderBy("timestamp").collect()]
    assert got == [("2015-01-01 00:00:00", -10.5, 60.0), ("2015-01-01 13:00:00", None, 65.0), ("2015-01-01 18:00:00.500000", -1.0, 65.0)]
