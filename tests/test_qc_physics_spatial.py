import numpy as np
import pytest
from helpers import at, column, ordered, series
from pyspark.sql import functions as F

from fieldwatch.functions import physics
from fieldwatch.functions.geo import haversine_km, pressure_at
from fieldwatch.operators import hourly_qc, qc, recovery, spatial, votes
from fieldwatch.operators.multivariate import multivariate_batch

EVENT = [
    (at("2016-09-09 15:00"), -22.0, 946.4, 40.0),
    (at("2016-09-09 16:00"), -22.2, 946.5, 39.0),
    (at("2016-09-09 17:00"), 41.6, 946.7, 100.0),
    (at("2016-09-09 18:00"), -17.8, 946.8, 37.0),
]


def test_known_event(spark):
    rows = ordered(qc.quality_control(series(spark, EVENT)))
    assert rows[1].qc_flag == "PASSED"
    assert rows[2].qc_flag == "SUSPECT" and rows[2].temperature_spike and rows[2].humidity_spike
    assert any("41.60 > 25.00" in r for r in rows[2].qc_reasons)
    assert "temperature_spike: step rate of 63.80/hr exceeded threshold of 8.00/hr (delta=63.80 in 1.0h)" in rows[2].qc_reasons


def test_no_rate_across_a_gap(spark):
    rows = series(spark, [(0, -15.0, 980.0, 50.0), (5, 5.0, 980.0, 50.0)])
    got = ordered(qc.rate_of_change(rows))[1]
    assert got.temperature_rate is None and not got.temperature_spike
    assert ordered(qc.quality_control(rows))[1].gap_flag


def test_flatline_with_head_not_tail(spark):
    values = [-5.0, -8.0, -10.0, -10.0, -10.0, -10.0, -9.0, -7.0]
    rows = series(spark, [(i, v, 980.0 + i, 50.0 + i) for i, v in enumerate(values)])
    assert column(qc.flatline(rows), "temperature_flatline") == [False, False, True, True, True, True, False, False]


def test_missing_and_repeated_times(spark):
    rows = series(spark, [(0, -10.0, None, 60.0), (0, 20.0, 900.0, 60.0)])
    got = qc.quality_control(rows).where("pressure is null").first()
    assert got.qc_flag == "MISSING" and got.qc_reasons == ["pressure_missing"]


def test_thresholds_per_station(spark):
    rows = series(spark, [(0, 10.0, 900.0, 60.0)]).unionByName(series(spark, [(0, 10.0, 900.0, 60.0)], "B"))
    limits = spark.createDataFrame([("B", 5.0)], "station_id string, temperature_max double")
    got = {r.station_id: r.qc_flag for r in qc.quality_control(rows, thresholds=limits).collect()}
    assert got == {"A": "PASSED", "B": "SUSPECT"}


def test_hourly_profile_median_skips_missing(spark):
    rows = series(spark, [(0, None, 1.0, 1.0), (1, 0.0, 1.0, 1.0), (2, 8.0, 1.0, 1.0), (3, 8.0, 1.0, 1.0)])
    got = ordered(hourly_qc.local_spike(rows))
    assert got[1].temperature_local_median == 4.0 and got[1].temperature_spike_flag
    assert got[2].temperature_local_median == 8.0


def test_hourly_flatline_needs_five(spark):
    rows = series(spark, [(i, 1.0 if i < 4 else 2.0, None, float(i)) for i in range(9)])
    assert column(hourly_qc.flatline_flags(rows), "temperature_flatline_flag") == [False] * 4 + [True] * 5
    assert not any(column(hourly_qc.flatline_flags(rows), "pressure_flatline_flag"))


@pytest.mark.parametrize("size", [3, 4, 7, 1000])
def test_block_size_does_not_change_checks(spark, size):
    rng = np.random.default_rng(5)
    hours = np.cumsum(rng.choice([1, 1, 1, 1, 3], 90))
    data = [(int(h), *(None if rng.random() < 0.1 else float(x) for x in rng.integers(0, 3, 3))) for h in hours]
    rows = series(spark, data)
    key = "spark.fieldwatch.block.rows"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "1000")
        spark.conf.set("spark.fieldwatch.block.bucket", "hour")
        want = [r.asDict(True) for r in ordered(qc.quality_control(rows))]
        want2 = [r.asDict(True) for r in ordered(hourly_qc.hourly_qc(rows))]
        spark.conf.set(key, str(size))
        assert [r.asDict(True) for r in ordered(qc.quality_control(rows))] == want
        assert [r.asDict(True) for r in ordered(hourly_qc.hourly_qc(rows))] == want2
    finally:
        spark.conf.set(key, before)
        spark.conf.unset("spark.fieldwatch.block.bucket")


def values(spark, *cols):
    return [tuple(r) for r in spark.range(1).select(*cols).collect()][0]


def test_physics(spark):
    t = F.lit
    es0, es10, td, ice, spread = values(
        spark,
        physics.saturation_vapor_pressure(t(0.0)),
        physics.saturation_vapor_pressure(t(-10.0)),
        physics.dew_point(t(15.0), t(100.0)),
        physics.dew_point(t(-15.0), t(100.0)),
        physics.dew_point_spread(t(20.0), t(50.0)),
    )
    assert es0 == pytest.approx(6.112) and 0 < es10 < 6.112
    assert td == pytest.approx(15.0) and ice == pytest.approx(-15.0)
    assert abs(spread - 10.7) < 1.5


def test_distance_and_elevation(spark):
    km, p = values(
        spark,
        haversine_km(F.lit(-70.767), F.lit(11.733), F.lit(-70.776), F.lit(11.832)),
        pressure_at(F.lit(950.0), F.lit(117.0), F.lit(102.0)),
    )
    assert 3 <= km <= 6 and p == pytest.approx(951.79, abs=0.01)


def check(spark, target, buddy):
    dims = spark.createDataFrame(
        [("A", "Base", -70.767, 11.733, 117.0), ("B", "Near", -70.776, 11.832, 102.0)],
        "station_id string, station_name string, latitude double, longitude double, elevation_m double",
    )
    pairs = spark.createDataFrame([("A", "B", 0)], "station_id string, neighbour_id string, preference int")
    obs = series(spark, [(0, *target)])
    readings = spark.createDataFrame(
        [("A", obs.first().timestamp, *buddy)] if buddy else [],
        "station_id string, timestamp timestamp_ntz, buddy_station_id string, buddy_temperature double, buddy_pressure double, buddy_humidity double",
    )
    return spatial.spatial_check(spatial.buddy_join(obs, readings, spatial.station_distances(dims, pairs))).first()


def test_neighbours(spark):
    got = check(spark, (-28.0, 960.0, 65.0), ("B", -27.5, 961.5, 68.0))
    assert got.spatial_status == "NORMAL_CONSISTENT" and got.spatial_agreement and got.spatial_score == 0.8
    got = check(spark, (41.6, 946.0, 100.0), ("other", -22.0, 947.0, 45.0))
    assert got.spatial_status == "ISOLATED_DISCORDANCE" and got.spatial_score == -1.0
    assert got.buddy_station_id == "B"
    got = check(spark, (1.0, 1.0, 1.0), None)
    assert got.spatial_status == "UNAVAILABLE" and got.spatial_score == 0.0 and got.spatial_agreement is None
    got = check(spark, (1.0, 1.0, 1.0), ("B", None, None, None))
    assert got.spatial_reasons == ["Neighboring station Near data is missing or empty."]


def test_differences_round_by_their_binary_value():
    """6.005 is a little less than that in binary: it rounds to 6.0, which is within the tolerance."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from fieldwatch.functions.text import round_even

    values = [6.005, 2.675, 0.125, 0.375, -6.005, 6.015, 1e6 + 0.005]
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.r for r in df.select(round_even(F.col("v"), 2).alias("r")).collect()] == [round(v, 2) for v in values]


def test_recovery_of_the_known_event(spark):
    rows = qc.quality_control(series(spark, EVENT))
    rows = rows.withColumn("flagged", F.lit(True)).withColumn(
        "which", F.array(*[F.lit(c) for c in ("temperature", "pressure", "humidity")])
    )
    got = recovery.recover_neighbors(rows, "flagged", "which")
    by = {(r.timestamp.hour, r.parameter): r for r in got.collect()}
    assert by[17, "temperature"].estimated_value == pytest.approx(-20.0)
    assert by[17, "pressure"].estimated_value == pytest.approx(946.65)
    assert by[17, "humidity"].estimated_value == pytest.approx(38.0)
    assert by[17, "temperature"].previous_timestamp == "2016-09-09T16:00:00"
    assert by[18, "temperature"].recovery_status == "NOT_APPLICABLE"
    bad = series(spark, [(0, -300.0, 1.0, 1.0), (1, 5.0, 1.0, 1.0), (2, 5.0, 1.0, 1.0)])
    bad = bad.withColumn("flagged", F.lit(True)).withColumn("which", F.array(F.lit("temperature")))
    out = ordered(recovery.recover_neighbors(bad, "flagged", "which"))[1]
    assert out.message == recovery.BAD_NEIGHBORS


def test_votes_keep_rows_and_values(spark):
    rows = series(spark, EVENT)
    out = multivariate_batch(hourly_qc.hourly_qc(rows, gated=False, spikes=False))
    out = votes.vote(out.withColumns({"if_anomaly": F.lit(True), "sequence_anomaly": F.lit(False)}))
    out = recovery.recover_hourly(votes.attribute_parameters(out))
    got = ordered(out)
    assert [(r.temperature, r.pressure, r.humidity) for r in got] == [e[1:] for e in EVENT]
    assert got[2].estimated_temperature == pytest.approx(-20.0) and got[2].estimated_pressure is None
    assert got[3].recovery_reason == recovery.HOURLY_TEXTS["edge"]


def test_printed_halves_follow_the_binary_value(spark):
    from fieldwatch.functions.text import tie_even

    xs = [70.55, 62.25, 62.35, 62.45, 78.75, 0.15, 0.25, 0.35, 21.25, 99.95, -0.25, -70.55, 12.3, 0.0, 100.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(F.format_string("%.1f", tie_even(F.col("x"), 1))).collect()]
    assert got == [f"{x:.1f}" for x in xs]


def test_undated_rows_are_spread_over_blocks(spark):
    from fieldwatch.timeline import Timeline

    rows = spark.range(1000).selectExpr("'A' AS station_id", "cast(null AS timestamp_ntz) AS timestamp", "cast(id AS double) AS temperature")
    tl = Timeline(rows, lookback=2)
    blocks = {r["_blk"]: r["count"] for r in tl.df.where("_core").groupBy("_blk").count().collect()}
    assert sum(blocks.values()) == 1000 and max(blocks.values()) <= 14 and len(blocks) > 70
    got = tl.done(tl.df.withColumn("before", tl.lag("temperature")))
    assert got.columns == [*rows.columns, "before"] and got.where("before IS NULL").count() == 1
