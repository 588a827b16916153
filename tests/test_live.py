import numpy as np
import pandas as pd
import pytest
from helpers import START, at, series
from pyspark.sql import functions as F
from test_decisions import observations

from fieldwatch import decisions
from fieldwatch.operators import alerts
from fieldwatch.operators.health import DRIFT_SLACK, SPANS
from fieldwatch.plans.q_decisions import CLOSE, EXACT
from fieldwatch.session import BLOCK_ROWS, work_path
from fieldwatch.sources import logstore
from fieldwatch.streaming import decisions as live
from fieldwatch.streaming import jobs, state


def plain(value, suspect, missing, flat):
    """The running metrics, row by row."""
    marks, steps, last, up, down, run, gone, odd, out = [], [], float("nan"), 0.0, 0.0, 0, 0, 0, []
    for v, s, m, f in zip(value, suspect, missing, flat):
        marks.append(bool(s or m))
        gone, odd, run = gone + m, odd + (s and not m), run + 1 if f else 0
        if not np.isnan(v):
            if not np.isnan(last):
                steps.append(v - last)
                if not s:
                    up, down = max(0.0, up + v - last - DRIFT_SLACK), max(0.0, down - (v - last) - DRIFT_SLACK)
            last = v
        rates = [sum(marks[-n:]) / min(n, len(marks)) for n in SPANS.values()]
        out.append([*rates, np.var(steps[-24:]) if len(steps) > 2 else 0.0, max(up, down), len(marks), len(marks) - gone - odd, odd, gone, run])
    return np.array(out, dtype=float)


@pytest.mark.parametrize("pieces", [[400], [1] * 60, [0, 7, 1, 250, 3, 139]])
def test_running_health_in_pieces_equals_a_loop(pieces):
    draw = np.random.default_rng(len(pieces))
    n = sum(pieces)
    value = np.round(np.cumsum(draw.normal(0, 1.5, n)), 2)
    value[draw.random(n) < 0.15] = np.nan
    suspect, missing, flat = draw.random(n) < 0.2, np.isnan(value) | (draw.random(n) < 0.05), draw.random(n) < 0.6
    known, got, a = state.Running(), [], 0
    for size in pieces:
        part = slice(a, a + size)
        out, known = state.advance(known, value[part], suspect[part], missing[part], flat[part])
        known = state.Running.load(known.row())
        got.append(np.column_stack([out[k] for k in state.METRICS]))
        a += size
    assert np.allclose(np.vstack(got), plain(value, suspect, missing, flat))


def arrivals(spark, parts, name="arriving"):
    path = work_path(spark, name)
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    return jobs.stream_obs(spark, path, parts[0].schema)


def test_live_job_equals_the_batch_job(spark):
    """Two stations; a spike, a frozen sensor, missing rows, a gap, and rows that come out of
    order.  The frozen run starts in one micro-batch and is known in the next."""
    state.use_rocksdb(spark)
    block = spark.conf.get(BLOCK_ROWS)
    spark.conf.set(BLOCK_ROWS, "100")
    try:
        obs = observations(spark)
        frozen = F.col("timestamp").between(at("2015-01-06 06:00"), at("2015-01-06 11:00"))
        obs = obs.withColumn("humidity", F.when(frozen, 55.5).otherwise(F.col("humidity"))).where("timestamp <> '2015-01-04 05:00:00'")
        obs = obs.unionByName(obs.where("timestamp < '2015-01-02 20:00:00'").withColumn("station_id", F.lit("B"))).cache()
        near = [F.lit("N").alias("buddy_station_id"), F.lit(-15.0).alias("buddy_temperature"), F.lit(980.0).alias("buddy_pressure"), F.lit(60.0).alias("buddy_humidity")]
        readings = obs.where("station_id = 'A'").select("station_id", "timestamp", *near)
        pairs = spark.createDataFrame(
            [("A", "N", "Near", 3.0, 100.0, 100.0, 1)],
            "station_id string, neighbour_id string, neighbour_name string, distance_km double, elevation_m double, neighbour_elevation_m double, preference int",
        )
        models = decisions.fit_models(obs, decisions.Settings(trees=10))
        want = {(r.station_id, r.timestamp): r for r in decisions.run_decisions(obs, readings, pairs, models=models).collect()}
        # Cut inside the frozen run; two rows change places across the cut.
        first = F.col("timestamp") < at("2015-01-06 08:00")
        first = (first & (F.col("timestamp") != at("2015-01-06 07:00"))) | (F.col("timestamp") == at("2015-01-06 08:00"))
        path, log, checkpoint = (work_path(spark, n) for n in ("live", "live-log", "live-checkpoint"))
        stream = arrivals(spark, [obs.where(first), obs.where(~first)])
        live.decision_stream(stream, readings, pairs, models, path, checkpoint, log, "now").awaitTermination()
        got = {(r.station_id, r.timestamp): r for r in live.current_decisions(spark, path).collect()}
        assert got.keys() == want.keys()
        for key, w in want.items():
            g = got[key]
            assert [g[c] for c in EXACT] == [w[c] for c in EXACT], key
            assert [g[c] for c in CLOSE] == pytest.approx([w[c] for c in CLOSE], abs=2e-6), key
            assert (g.qc_reasons, g.flatline_flags, g.affected_parameters) == (w.qc_reasons, w.flatline_flags, w.affected_parameters)
        assert sum(r.flatline_flags["humidity"] for r in want.values()) == 6
        assert sum(not r.final for r in got.values()) == 6  # three open rows a station
        logged = alerts.read_log(spark, log)
        assert logged.count() >= sum(w.classification != "NORMAL" for w in want.values()) > 3
        # A micro-batch that is run again changes nothing.
        before, files = sorted(map(str, logged.collect())), logstore.version(spark, log)
        batch = live.checked_stream(stream)
        again = jobs.run_to_files(batch, "again")
        live.write_batch(again, 1, path, readings, pairs, models, log, "now")
        assert logstore.version(spark, log) == files and sorted(map(str, alerts.read_log(spark, log).collect())) == before
        once_more = {(r.station_id, r.timestamp): r for r in live.current_decisions(spark, path).collect()}
        assert {k: r.classification for k, r in once_more.items()} == {k: r.classification for k, r in got.items()}
    finally:
        spark.conf.set(BLOCK_ROWS, block)


def test_rows_before_the_last_final_one_are_left_out(spark):
    state.use_rocksdb(spark)
    rows = series(spark, [(i, float(i), 950.0, 50.0 + i) for i in range(10)])
    late = series(spark, [(at("2015-01-01 02:30"), 99.0, 950.0, 50.0), (10, 10.0, 950.0, 60.0)])
    out = jobs.run_to_files(state.stream_context(arrivals(spark, [rows, late])), "context").collect()
    final = {r.timestamp for r in out if r.final}
    assert all(r.temperature != 99.0 for r in out) and len(final) == 8 and len({r.timestamp for r in out}) == 11


LOG = "id bigint, timestamp timestamp_ntz, station_id string, classification string, severity string, alert_key string, parameter string, anomaly_type string, payload_json string, created_at string"


def rows_of(spark, rows):
    data = [(i, START + pd.Timedelta(hours=h).to_pytimedelta(), "A", "UNCERTAIN", s, k, None, None, "{}", f"t{i}") for i, h, s, k in rows]
    return spark.createDataFrame(data, LOG)


def files(spark, path):
    return set(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/data").select("path").toPandas()["path"])


def test_a_writer_that_dies_before_its_commit_leaves_the_log_as_it_was(spark, monkeypatch):
    path = work_path(spark, "log")
    alerts.upsert_table(spark, path, rows_of(spark, [(1, 0, "LOW", "k1"), (2, 30, "LOW", "k2")]))
    old = sorted(map(str, alerts.read_log(spark, path).collect()))
    with monkeypatch.context() as m:
        m.setattr(logstore, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            alerts.upsert_table(spark, path, rows_of(spark, [(3, 0, "HIGH", "k1"), (4, 55, "LOW", "lost")]))
    assert len(files(spark, path)) > 2  # its data lie there, unlisted
    assert sorted(map(str, alerts.read_log(spark, path).collect())) == old
    alerts.upsert_table(spark, path, rows_of(spark, [(5, 0, "MEDIUM", "k1")]))
    got = {r.alert_key: (r.id, r.severity, r.created_at) for r in alerts.read_log(spark, path).collect()}
    assert got == {"k1": (1, "MEDIUM", "t1"), "k2": (2, "LOW", "t2")}


def test_a_commit_writes_its_own_rows_only_and_days_are_folded(spark):
    path = work_path(spark, "log")
    alerts.upsert_table(spark, path, rows_of(spark, [(i, i, "LOW", f"k{i}") for i in range(48)]))
    before = files(spark, path)
    alerts.upsert_table(spark, path, rows_of(spark, [(100, 3, "HIGH", "k3"), (101, 3, "HIGH", None)]), "batch-1")
    added = files(spark, path) - before
    assert before < files(spark, path) and spark.read.parquet(*added).count() == 2
    alerts.upsert_table(spark, path, rows_of(spark, [(100, 3, "HIGH", "k3"), (101, 3, "HIGH", None)]), "batch-1")
    assert alerts.read_log(spark, path).count() == 49
    for i in range(logstore.MOST_VERSIONS):
        alerts.upsert_table(spark, path, rows_of(spark, [(200 + i, 3, "MEDIUM", "k3")]))
    listed = logstore.days(logstore.entries(spark, path))
    assert max(len(d["commits"]) for d in listed) <= logstore.MOST_VERSIONS
    (row,) = alerts.read_log(spark, path).where("alert_key = 'k3'").collect()
    assert (row.id, row.created_at, row.severity) == (3, "t3", "MEDIUM") and alerts.read_log(spark, path).count() == 49
    assert alerts.clear_log(spark, path) == 49 and alerts.read_log(spark, path).count() == 0
    alerts.upsert_table(spark, path, rows_of(spark, [(1, 0, "LOW", "k1")]))
    assert alerts.read_log(spark, path).count() == 1


def test_reads_open_only_the_days_they_need(spark):
    path = work_path(spark, "log")
    hours = [(i, 6 * i, "CRITICAL" if i % 4 == 0 else "LOW", f"k{i}") for i in range(80)]  # four a day, twenty days
    alerts.upsert_table(spark, path, rows_of(spark, hours))
    alerts.upsert_table(spark, path, rows_of(spark, [(500, 6 * 79, "CRITICAL", "k79"), (501, 6 * 3, "HIGH", "k3")]))
    everything = alerts.read_log(spark, path)
    assert len(logstore.days(logstore.entries(spark, path))) == 20
    for page, filters in ((1, {}), (2, {"severity": "critical"}), (5, {"severity": "critical"}), (9, {})):
        got = alerts.log_page(spark, path, page, 5, **filters).collect()
        want = alerts.alerts_page(everything, page, 5, **filters).collect()
        assert sorted(map(str, got)) == sorted(map(str, want))
    keep = lambda rows: alerts.alert_filter(alerts.anomalies(rows), severity="critical")
    assert len(alerts.newest_days(spark, path, 1, keep)) == 1
    assert 3 <= len(alerts.newest_days(spark, path, 4, keep)) <= 8
    one = alerts.log_row(spark, path, 42)
    assert [r.alert_key for r in one.collect()] == ["k42"] and len(one.inputFiles()) == 1
    (row,) = alerts.log_row(spark, path, 3).collect()
    assert (row.alert_key, row.severity) == ("k3", "HIGH")
    assert alerts.log_row(spark, path, 501).count() == 0 and alerts.log_row(spark, path, 9999).count() == 0


def test_windows_drop_late_rows_and_segments_wait_for_them(spark):
    def part(hours):
        return series(spark, [(h, 1.0, 950.0, 50.0) for h in hours]).withColumn("qc_flag", F.lit("SUSPECT")).select("station_id", "timestamp", "qc_flag")

    weeks = [part([0, 1, 2, 30]), part([3, 31, 60]), part([4, 29, 100])]
    got = jobs.run_arrivals(weeks, lambda s: jobs.windowed_health(s, "24 hours", late="7 hours"), "w")
    # Hour 4 comes when event time stands at 60 - 7: its day is closed, as that of hour 29; hour 3 is in time.
    assert [(r.window_start.day, r["rows"]) for r in got.orderBy("window_start").collect()] == [(1, 4), (2, 2), (3, 1)]
    got = jobs.run_arrivals(weeks, lambda s: jobs.segments(s, 1.0, late="2 days"), "s")
    rows = [((r.segment_start - START).total_seconds() / 3600, r["rows"]) for r in got.orderBy("segment_start").collect()]
    assert rows == [(0.0, 4), (29.0, 3)]  # hour 4 is too late, hour 29 is not, hour 60 is still open


def test_micro_batches_do_not_grow_with_files(spark):
    """One micro-batch per time window, however many files it came in."""
    from fieldwatch.plans.q_streaming import in_order

    stamps = spark.sql("SELECT explode(sequence(timestamp_ntz'2024-01-01', timestamp_ntz'2024-01-30', interval 1 day)) AS timestamp")
    rows = spark.range(40).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("station_id")).crossJoin(stamps)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    seen = []
    try:
        job = in_order(rows).writeStream.foreachBatch(lambda batch, _: seen.append(batch.agg(F.min("timestamp"), F.max("timestamp"), F.count("*")).first()))
        job.option("checkpointLocation", work_path(spark, "batches")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r[2] for r in seen] == [320, 320, 320, 240]
    assert all(a[1] < b[0] for a, b in zip(seen, seen[1:]))


def batches_of(spark, rows):
    """Rows, stations, first and last time of each micro-batch."""
    from fieldwatch.plans.q_streaming import in_order

    seen = []
    what = [F.count("*"), F.count_distinct("station_id"), F.min("timestamp"), F.max("timestamp")]
    stream = in_order(rows)
    assert stream.columns == rows.columns
    job = stream.writeStream.foreachBatch(lambda batch, _: seen.append(tuple(batch.agg(*what).first())))
    job.option("checkpointLocation", work_path(spark, "batches")).trigger(availableNow=True).start().awaitTermination()
    return seen


def test_a_micro_batch_is_a_time_window_with_rows(spark):
    """Also where a window has no rows, as before a pre-warmed stream, or stations of its own."""
    stamps = spark.sql("SELECT explode(sequence(timestamp_ntz'2024-01-01', timestamp_ntz'2024-01-30', interval 1 day)) AS timestamp")
    rows = spark.range(40).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("station_id")).crossJoin(stamps)
    late = batches_of(spark, rows.where("timestamp >= '2024-01-15'"))
    assert [b[:2] for b in late] == [(80, 40), (320, 40), (240, 40)]
    assert all(a[3] < b[2] for a, b in zip(late, late[1:]))
    few = rows.where("station_id = 'S1' or timestamp >= '2024-01-17' or (station_id < 'S12' and timestamp >= '2024-01-09')")
    assert [b[:2] for b in batches_of(spark, few)] == [(8, 1), (32, 4), (320, 40), (240, 40)]
    assert [b[0] for b in batches_of(spark, rows.where("timestamp < '2024-01-05' or timestamp >= '2024-01-28'"))] == [160, 120]
    assert [b[0] for b in batches_of(spark, rows.where("false"))] in ([], [0])
    unnamed = rows.withColumn("station_id", F.when(F.col("station_id") != "S3", F.col("station_id")))
    assert [b[:2] for b in batches_of(spark, unnamed)] == [(320, 39), (320, 39), (320, 39), (240, 39)]
