import math
from collections import deque

import numpy as np
import pytest
from helpers import at, column, ordered, series
from pyspark.sql import functions as F

from fieldwatch.operators import evaluation, features, fusion, health, multivariate, qc, sequences
from fieldwatch.ranks import quantiles, share_at_most

SIGNALS = """station_id string, timestamp timestamp_ntz, temperature double, pressure double, humidity double,
  qc_flag string, qc_reasons array<string>, temperature_spike boolean, pressure_spike boolean, humidity_spike boolean,
  temperature_flatline boolean, pressure_flatline boolean, humidity_flatline boolean, gap_flag boolean,
  iforest_score double, iforest_flag boolean, sequence_mse double, sequence_flag boolean,
  multivariate_anomaly boolean, multivariate_score double, spatial_status string, spatial_score double,
  spatial_agreement boolean, buddy_station_id string, overall_health_index double, overall_status string,
  active_alerts array<string>"""


def decide(spark, values, flag="PASSED", reasons=(), spike=(), models=(0.1, False, 0.01, False), near=None):
    spikes = [c in spike for c in ("temperature", "pressure", "humidity")]
    status, score, agree, buddy = near or ("UNAVAILABLE", 0.0, None, None)
    row = ("A", at("2016-09-09 17:00"), *values, flag, list(reasons), *spikes, False, False, False, False, *models,
           False, None, status, score, agree, buddy, 100.0, "OPERATIONAL", [])
    return fusion.fuse(spark.createDataFrame([row], SIGNALS)).first()


AGREE = ("NORMAL_CONSISTENT", 0.8, True, "B")
HOT = ["temperature_plausibility_violation: 41.60 > 25.00", "temperature_spike: step rate of 63.80/hr"]


def test_clean_row_is_normal(spark):
    got = decide(spark, (-28.0, 960.0, 65.0), near=AGREE)
    assert (got.classification, got.severity) == ("NORMAL", "NONE") and got.confidence > 0.8
    assert got.evidence == [] and got.primary_parameter is None


def test_discordant_spike_is_a_fault(spark):
    far = ("ISOLATED_DISCORDANCE", -1.0, False, "B")
    got = decide(spark, (41.6, 946.0, 100.0), "SUSPECT", HOT, ("temperature",), (0.9, True, 0.3, True), far)
    assert (got.classification, got.severity, got.primary_parameter) == ("LIKELY_SENSOR_DATA_FAULT", "CRITICAL", "temperature")
    assert got.confidence >= 0.85 and "buddy station B" in got.operator_action
    assert got.maintenance_status == "Inspection Recommended"
    alone = decide(spark, (41.6, 946.0, 100.0), "SUSPECT", HOT, ("temperature",), (0.9, True, 0.3, True))
    assert (alone.classification, alone.severity) == ("LIKELY_SENSOR_DATA_FAULT", "CRITICAL")


def test_agreed_pressure_fall_is_weather(spark):
    got = decide(spark, (-20.0, 950.0, 80.0), "SUSPECT", ["pressure_spike: step rate of 8.00/hr"], ("pressure",), (0.7, False, 0.1, False), AGREE)
    assert (got.classification, got.severity) == ("LIKELY_GENUINE_WEATHER_EVENT", "MEDIUM") and got.confidence >= 0.75


def test_model_only_is_uncertain(spark):
    got = decide(spark, (-20.0, 950.0, 60.0), models=(0.82, True, 0.02, False))
    assert got.classification == "UNCERTAIN" and got.confidence is None


def test_all_missing(spark):
    got = decide(spark, (None, None, None), "MISSING", ["temperature_missing", "pressure_missing", "humidity_missing"])
    assert (got.classification, got.severity, got.primary_parameter) == ("UNCERTAIN", "HIGH", "all")
    assert [e.pillar for e in got.evidence] == ["DATA_INTEGRITY"] and got.evidence_scores == {"completeness": 0.0}


def brute_health(values, suspect, missing, flat):
    """One sensor, step by step."""
    out = []
    err = {24: deque(maxlen=24), 168: deque(maxlen=168), 720: deque(maxlen=720)}
    steps, last, up, down, run = deque(maxlen=24), None, 0.0, 0.0, 0
    for v, s, m, f in zip(values, suspect, missing, flat):
        for q in err.values():
            q.append(s or m)
        run = run + 1 if f else 0
        if v is not None:
            if last is not None:
                steps.append(v - last)
                if not s:
                    up, down = max(0, up + v - last - 0.5), max(0, down - v + last - 0.5)
            last = v
        rates = [sum(q) / len(q) for q in err.values()]
        out.append((*rates, float(np.var(steps)) if len(steps) > 2 else 0.0, max(up, down), run))
    return out


def test_running_health_equals_step_by_step(spark):
    rng = np.random.default_rng(11)
    data = []
    value = -10.0
    for i in range(120):
        value += float(rng.choice([0, 0, 0, 0.5, -1, 3]))
        data.append((i, None if rng.random() < 0.15 else value, 950.0, 60.0))
    rows = qc.quality_control(series(spark, data))
    flags = health.parameter_suspect_flags(rows)
    f = ordered(flags)
    want = brute_health(
        [r.temperature for r in f],
        [r.temperature_suspect for r in f],
        [r.missing_flag or r.temperature is None for r in f],
        [r.temperature_flat for r in f],
    )
    got = ordered(health.parameter_health(rows).where("parameter = 'temperature'"))
    names = ("error_rate_24h", "error_rate_7d", "error_rate_30d", "noise_variance", "cusum_drift", "consecutive_flatlines")
    for g, w in zip(got, want):
        assert [g[n] for n in names] == pytest.approx(w, abs=1e-9)


def test_health_of_clean_and_bad_sensors(spark):
    clean = series(spark, [(i, -10.0 - i / 100, 950.0 + i / 100, 60.0 + i / 10) for i in range(5)])
    got = health.parameter_health(qc.quality_control(clean))
    assert got.agg(F.min("health_index")).first()[0] >= 95
    bad = series(spark, [(i, 40.0, 950.0 + i / 100, 60.0 + i / 10) for i in range(20)])
    last = ordered(health.parameter_health(qc.quality_control(bad)).where("parameter = 'temperature'"))[-1]
    assert last.health_index < 60 and last.error_rate_24h > 0.8
    station = ordered(health.station_health(health.parameter_health(qc.quality_control(bad))))[-1]
    assert station.overall_status in ("DEGRADED", "CRITICAL_ATTENTION") and station.active_alerts


HISTORY = "station_id string, timestamp timestamp_ntz, temperature double, pressure double, humidity double, temperature_qc_flag string, temperature_anomaly boolean, temperature_flatline boolean"


def history(spark, rows):
    start = at("2020-01-01 00:00")
    from datetime import timedelta

    return spark.createDataFrame(
        [("A", start + timedelta(hours=i), t, 1.0, 1.0, q, a, f) for i, (t, q, a, f) in enumerate(rows)], HISTORY
    )


def test_longterm_health(spark):
    clean = health.longterm_health(history(spark, [(1.0, "PASSED", False, False)] * 100))
    assert clean.where("parameter = 'temperature'").first().health_index == 100.0
    rows = [(None if i < 30 else 1.0, "SUSPECT" if i < 20 else "PASSED", i >= 70, i < 20) for i in range(100)]
    got = health.longterm_health(history(spark, rows)).where("parameter = 'temperature'").first()
    assert got.health_index < 80 and got.recent_anomaly_trend == pytest.approx(0.7)


def test_expanding_scores_equal_step_by_step(spark):
    rng = np.random.default_rng(3)
    data = [(i, *[float(x) for x in rng.normal(0, 5, 3)]) for i in range(60)]
    got = column(multivariate.multivariate_expanding(series(spark, data), qc_flag=None), "multivariate_score")
    x = np.array([d[1:] for d in data])
    for k in range(60):
        if k < 2:
            assert got[k] is None
            continue
        change = np.diff(x[: k + 1], axis=0)
        z = (change[-1] - change.mean(axis=0)) / change.std(axis=0, ddof=1)
        assert got[k] == pytest.approx(math.sqrt((z**2).sum()), rel=1e-9)


def test_windows_stay_inside_segments(spark):
    hours = [*range(15), *range(20, 35)]
    rows = series(spark, [(h, 1.0, 2.0, 3.0) for h in hours])
    assert sequences.sequence_windows(rows, 20).count() == 0
    assert sequences.sequence_windows(rows, 10).count() == 12
    full = series(spark, [(h, 1.0, 2.0, 3.0) for h in range(120)])
    assert sequences.sequence_windows(full).count() == 97


def test_changes_reset_at_gaps(spark):
    rows = series(spark, [(h, t, 1.0, 1.0) for h, t in zip((0, 1, 2, 7, 8), (10.0, 11.0, 12.0, 25.0, 26.0))])
    assert column(features.step_changes(rows), "temperature_change") == [0.0, 1.0, 1.0, 0.0, 1.0]


def test_quantiles_and_ranks_are_exact(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(985, 0.01, 300), rng.integers(-3, 3, 100) * 1.0, [0.0, -0.5, 0.5]])
    df = spark.createDataFrame([("A", float(v)) for v in values], "k string, v double")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 0.995, "f": 1.0}
    got = quantiles(df, ["k"], "v", probs).first()
    for name, p in probs.items():
        assert got[name] == pytest.approx(np.quantile(values, p), abs=1e-9)
    ranked = share_at_most(df, "v", df.select("k", F.col("v").alias("r")), "r", "s", ["k"]).collect()
    for r in ranked[:50]:
        assert r.s == pytest.approx((values <= r.v).mean() * 100)


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_series_are_merged_not_collected(spark):
    """However small rows look when stored, no side of a join of series goes through the driver."""
    rows = series(spark, [(i, -10.0 + i % 5, 950.0, 50.0) for i in range(40)])
    checked = qc.quality_control(rows)
    plans = [_plan(health.station_health(health.parameter_health(checked)))]
    scores = rows.select("station_id", "timestamp", F.lit(True).alias("iforest_flag"), F.lit(False).alias("sequence_flag"))
    plans.append(_plan(evaluation.model_evidence(rows, scores, scores)))
    per_hour = rows.select("station_id", F.col("timestamp").alias("start"), F.col("timestamp").alias("stop"), F.lit("pressure").alias("channel"), F.lit(1.0).alias("value"), F.lit("Spike").alias("anomaly_type"))
    plans.append(_plan(evaluation.inject_anomalies(rows, per_hour)))
    for plan in plans:
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
