import numpy as np
import pytest
from helpers import ordered, series
from pyspark.sql import functions as F

from fieldwatch.config import FEATURES
from fieldwatch.operators import alerts, forest, health, qc, reconstruction, sequences
from fieldwatch.operators.features import feature_table, fit_scaler, scale
from fieldwatch.session import work_path
from fieldwatch.streaming import jobs, state


def spiky(spark, n=200):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        t = -20 + 5 * np.sin(i / 4) + rng.normal(0, 0.3)
        rows.append((i, float(35.0 if i == 150 else t), float(960 + np.cos(i / 9)), float(99.0 if i == 150 else 60 + 5 * np.sin(i / 7))))
    return series(spark, rows)


def test_forest_finds_the_spike_and_repeats(spark):
    rows = feature_table(spiky(spark))
    assert rows.where("valid_features").count() > 150 and len(FEATURES) == 16
    scaler = fit_scaler(rows, FEATURES)
    z = [f"{f}_z" for f in FEATURES]
    scaled = scale(rows, scaler, FEATURES)
    nodes = forest.fit_forest(scaled, z, trees=40)
    assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, forest.fit_forest(scaled, z, trees=40).collect()))
    scored = forest.score_forest(scaled, nodes, z)
    raw = [r.raw_score for r in ordered(scored)]
    assert min(raw) >= -1 and max(raw) < 0
    assert 150 in np.argsort(raw)[:3]
    decided = forest.decide(scored, forest.decision_offset(scored, 0.05))
    share = decided.agg(F.avg(F.col("anomaly_flag").cast("int"))).first()[0]
    assert 0.02 <= share <= 0.08
    bounds = forest.score_bounds(decided, "decision_score")
    out = ordered(forest.normalize_scores(decided, bounds, "decision_score", "s"))
    assert out[150].s > 0.5 and all(0 <= r.s <= 1 for r in out)


def test_forest_skips_rows_with_missing_features(spark):
    rows = feature_table(spiky(spark)).withColumn("pressure", F.when(F.col("temperature") < -22, None).otherwise(F.col("pressure")))
    nodes = forest.fit_forest(rows, FEATURES, trees=5)
    out = forest.score_forest(rows, nodes, FEATURES)
    assert out.where("pressure is null and raw_score is not null").count() == 0
    assert out.where("pressure is not null and raw_score is null").count() == 0


def test_reconstruction_error_is_largest_at_the_spike(spark):
    rows = spiky(spark)
    scaler = fit_scaler(rows, ("temperature", "pressure", "humidity"))
    windows = reconstruction.scaled_windows(sequences.sequence_windows(rows), scaler)
    model = reconstruction.fit_reconstruction(windows.where("timestamp < '2015-01-06'"), 6)
    out = ordered(reconstruction.reconstruction_errors(windows, model))
    worst = max(out, key=lambda r: r.mse)
    hour = (worst.timestamp - out[0].timestamp).total_seconds() / 3600 + 23
    assert 150 <= hour <= 173
    assert worst.mse == pytest.approx((worst.temperature_mse + worst.pressure_mse + worst.humidity_mse) / 3)


def arriving(spark, df, cuts):
    path = work_path(spark, "arriving")
    low = None
    for high in (*cuts, None):
        part = df if low is None else df.where(F.col("timestamp") >= low)
        part = part if high is None else part.where(F.col("timestamp") < high)
        part.coalesce(1).write.mode("append").parquet(path)
        low = high
    return jobs.stream_obs(spark, path, df.schema)


def noisy(spark):
    rng = np.random.default_rng(4)
    hours = np.cumsum(rng.choice([1, 1, 1, 1, 2], 150))
    return series(
        spark,
        [(int(h), *(None if rng.random() < 0.1 else float(x) for x in (rng.integers(-30, 30), rng.integers(940, 960), rng.integers(10, 99)))) for h in hours],
    )


CUTS = ("2015-01-02", "2015-01-04", "2015-01-06")


def test_streams_equal_batch(spark):
    state.use_rocksdb(spark)
    rows = noisy(spark)
    batch = qc.quality_control(rows)
    stream = jobs.run_to_files(state.stream_qc(arriving(spark, rows, CUTS), flatline=False), "qc")
    flat = ["temperature_flatline", "pressure_flatline", "humidity_flatline"]
    assert batch.where(" or ".join(flat)).count() == 0
    assert ordered(stream.select(batch.columns)) == ordered(batch)

    metrics = jobs.run_to_files(state.stream_health(arriving(spark, batch, CUTS)), "health")
    want = {(r.timestamp, r.parameter): r for r in health.parameter_health(batch).collect()}
    got = metrics.collect()
    assert len(got) == len(want)
    for g in got:
        w = want[g.timestamp, g.parameter]
        assert g.health_index == pytest.approx(w.health_index) and g.status == w.status
        assert g.clean_observations == w.clean_observations


def test_trailing_flatline_in_a_stream(spark):
    state.use_rocksdb(spark)
    rows = series(spark, [(i, 1.0, 950.0 + i, 20.0 + i) for i in range(6)])
    out = jobs.run_to_files(state.stream_qc(arriving(spark, rows, ())), "qc")
    assert [r.temperature_flatline for r in ordered(out)] == [False] * 3 + [True] * 3


def test_prewarmed_windows(spark):
    state.use_rocksdb(spark)
    rows = series(spark, [(i, float(i), 1.0, 1.0) for i in range(60)])
    fresh = rows.where("timestamp >= '2015-01-02 12:00:00'")
    cold = jobs.run_to_files(state.stream_sequences(arriving(spark, fresh, ())), "cold")
    warm = jobs.run_to_files(
        state.stream_sequences(arriving(spark, fresh, ()), history=rows.where("timestamp < '2015-01-02 12:00:00'")), "warm"
    )
    assert cold.count() == 1 and warm.count() == 24
    assert [w.temperature for w in ordered(warm)[0].window] == [float(i) for i in range(13, 37)]


LOG = """id bigint, timestamp timestamp_ntz, station_id string, classification string, severity string,
  alert_key string, parameter string, anomaly_type string, payload_json string, created_at string"""


def log_rows(spark, rows):
    from helpers import START
    from datetime import timedelta

    data = [
        (i, START + timedelta(hours=h), "A", c, s, k, None, None, "{}", f"t{i}") for i, h, c, s, k in rows
    ]
    return spark.createDataFrame(data, LOG)


def test_upsert_keeps_the_first_identity(spark):
    path = work_path(spark, "log")
    alerts.upsert_table(spark, path, log_rows(spark, [(1, 0, "UNCERTAIN", "LOW", "k1"), (2, 30, "UNCERTAIN", "LOW", "k2")]))
    alerts.upsert_table(spark, path, log_rows(spark, [(3, 0, "UNCERTAIN", "HIGH", "k1"), (4, 1, "UNCERTAIN", "LOW", "k3")]))
    got = {r.alert_key: r for r in alerts.read_log(spark, path).collect()}
    assert len(got) == 3
    assert (got["k1"].id, got["k1"].created_at, got["k1"].severity) == (1, "t1", "HIGH")
    assert got["k2"].id == 2


def test_pages_newest_first(spark):
    log = log_rows(spark, [(i, i, "UNCERTAIN", "CRITICAL", f"k{i}") for i in range(13)] + [(99, 99, "NORMAL", "NONE", "n")])
    one = alerts.alerts_page(log, 1, 10).collect()
    two = alerts.alerts_page(log, 2, 10).collect()
    assert (len(one), len(two)) == (10, 3) and one[0].id == 12 and one[0].total == 13 and one[0].total_pages == 2
    counts = {r.severity: r.alerts for r in alerts.severity_counts(log).collect()}
    assert counts == {"CRITICAL": 13, "HIGH": 0, "MEDIUM": 0, "LOW": 0}


def test_dedup_drops_rows_without_key(spark):
    log = log_rows(spark, [(1, 0, "UNCERTAIN", "LOW", "a"), (2, 1, "UNCERTAIN", "LOW", "a"), (3, 2, "UNCERTAIN", "LOW", None), (4, 3, "UNCERTAIN", "LOW", "")])
    assert [r.id for r in alerts.dedup_alerts(log).collect()] == [1]


def test_undated_rows_survive_and_keys_keep_their_day(spark):
    path = work_path(spark, "log")
    undated = F.when(F.col("id") != 2, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("timestamp"))
    first = log_rows(spark, [(1, 0, "UNCERTAIN", "LOW", "k1"), (2, 5, "UNCERTAIN", "LOW", "k2")]).withColumn("timestamp", undated)
    second = log_rows(spark, [(3, 0, "UNCERTAIN", "LOW", "k3")]).withColumn("timestamp", undated)
    for part in (first, second, second):
        alerts.upsert_table(spark, path, part)
    assert sorted(r.alert_key for r in alerts.read_log(spark, path).collect()) == ["k1", "k2", "k3"]
    key = "A|2015-03-01 10:00:00|temperature|x"
    for hours in (0, 72):  # the key's time counts, not the column's
        alerts.upsert_table(spark, path, log_rows(spark, [(9 + hours, hours, "UNCERTAIN", "LOW", key)]))
    rows = alerts.read_log(spark, path).where(F.col("alert_key") == key).collect()
    assert len(rows) == 1 and str(rows[0].log_day) == "2015-03-01"


def test_page_past_the_end_and_keyset_pages(spark):
    log = log_rows(spark, [(i, i // 2, "UNCERTAIN", "CRITICAL", f"k{i}") for i in range(13)])
    past = alerts.alerts_page(log, 9, 10).collect()
    assert len(past) == 1 and past[0].id is None and (past[0].total, past[0].total_pages) == (13, 2)
    one = alerts.alerts_page(log, 1, 5).collect()
    last = min(one, key=lambda r: (r.timestamp, r.id))
    following = alerts.alerts_before(log, last.timestamp, last.id, 5)
    assert sorted(r.id for r in following.collect()) == sorted(r.id for r in alerts.alerts_page(log, 2, 5).collect())


def test_rank_buckets_spread_at_every_magnitude(spark):
    from fieldwatch.ranks import bucket, quantiles

    for low in (1e-9, 1e9, -1e-9):
        df = spark.range(1, 2001).select((F.lit(low) * (1 + F.col("id") / 1000.0)).alias("v"))
        assert df.select(bucket(F.col("v"))).distinct().count() == 2000
    values = [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, 3.0, 3.0, -7.5, 1e-9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ordered = [r.b for r in df.select("v", bucket(F.col("v")).alias("b")).orderBy("v").collect()]
    assert ordered == sorted(ordered)
    got = quantiles(df, [], "v", {"q": 0.5}).first()["q"]
    assert got == sorted(values)[4] + (sorted(values)[5] - sorted(values)[4]) * 0.5
