import hashlib

import numpy as np
import pandas as pd
import pytest
from helpers import START, column, ordered, series
from pyspark.sql import functions as F

from fieldwatch.operators import cleaning, profile, structure
from fieldwatch.sources import tables


def test_raw_rows_are_cleaned(spark):
    raw = spark.createDataFrame(
        [
            ("A", "1/1/2015 0:00", -10.5, 985.2, 15.0, 180.0, 60.0),
            ("A", "1/1/2015 1:00", -11.0, 984.8, 18.0, 190.0, -999.0),
            ("A", "1/1/2015 2:00", -999.0, 984.5, 16.0, 185.0, 65.0),
            ("A", "1/1/2015 5:00", -12.5, -999.0, 20.0, 200.0, 70.0),
            ("A", "1/1/2015 6:00", -13.0, 983.9, 22.0, 210.0, -999.0),
        ],
        "station_id string, TimeStamp string, `Air Temperature` double, `Air Pressure` double, "
        "`Wind Speed` double, `Wind Direction` double, `Relative Humidity` double",
    )
    rows = cleaning.canonicalize_columns(cleaning.validate_columns(raw))
    rows = cleaning.parse_timestamps(cleaning.sentinels_to_null(rows))
    assert rows.count() == 5
    assert column(rows, "temperature")[2] is None and column(rows, "pressure")[3] is None
    assert structure.duplicate_count(rows).first()["duplicates"] == 0
    assert structure.time_gaps(rows).count() == 1
    assert structure.segment_ids(rows).select("segment_id").distinct().count() == 2


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError, match="Air Pressure"):
        cleaning.validate_columns(spark.range(1).withColumnRenamed("id", "TimeStamp"))


def test_nan_and_infinity_become_null(spark):
    df = spark.createDataFrame([("NaN",), ("inf",), ("x",), ("1.5",)], "v string")
    assert [r.v for r in cleaning.numeric_coerce(df, ["v"]).collect()] == [None, None, None, 1.5]
    nan = spark.createDataFrame([(float("nan"),), (-999.0,), (2.0,)], "v double")
    assert [r.v for r in cleaning.sentinels_to_null(nan).collect()] == [None, None, 2.0]


def test_duplicates(spark):
    rows = series(spark, [(0, 1.0, 1.0, 1.0), (1, 2.0, 1.0, 1.0), (1, 3.0, 1.0, 1.0), (2, 4.0, 1.0, 1.0)])
    rows = rows.withColumn("order", F.col("temperature"))
    assert structure.duplicate_count(rows).first()["duplicates"] == 1
    assert structure.duplicate_audit(rows).count() == 2
    assert column(structure.dedup_timestamps(rows, "order"), "temperature") == [1.0, 2.0, 4.0]
    assert column(structure.dedup_timestamps(rows, "order", "last"), "temperature") == [1.0, 3.0, 4.0]
    assert column(structure.dedup_timestamps(rows, "order", "none"), "temperature") == [1.0, 4.0]


def test_missing_profile(spark):
    rows = series(spark, [(i, v, 1.0, 1.0) for i, v in enumerate([1.0, None, None, 2.0, 3.0])])
    got = profile.missing_profile(rows).where("parameter = 'temperature'").first()
    assert (got.missing_count, got.missing_pct, got.max_consecutive_missing) == (2, 40.0, 2)


def test_gaps_and_segments(spark):
    rows = series(spark, [(h, 1.0, 1.0, 1.0) for h in (0, 1, 5, 6, 30)])
    gaps = structure.time_gaps(rows).orderBy("gap_id").collect()
    assert [(g.duration_hours, g.missing_steps) for g in gaps] == [(4.0, 3), (24.0, 23)]
    assert [(g.row_index_before, g.row_index_after) for g in gaps] == [(1, 2), (3, 4)]
    rows = series(spark, [(h, 1.0, 1.0, 1.0) for h in (0, 1, 2, 6, 7)])
    assert column(structure.segment_ids(rows), "segment_id") == [0, 0, 0, 1, 1]


def test_statistics(spark):
    rows = series(spark, [(i, 10.0 * (i + 1), 1000.0, None) for i in range(5)])
    got = {r.parameter: r for r in profile.parameter_statistics(rows).collect()}
    assert (got["temperature"].min, got["temperature"].max, got["temperature"].median) == (10.0, 50.0, 30.0)
    assert got["pressure"].std == 0.0
    assert got["humidity"]["count"] == 0 and got["humidity"].median == 0.0


def test_sentinels_across_undated_rows(spark):
    """Rows without a time stay, sorted last."""
    rows = series(spark, [(0, 1.0, 1.0, 1.0), (1, 2.0, 1.0, 1.0)])
    undated = rows.limit(1).withColumn("timestamp", F.lit(None).cast("timestamp_ntz"))
    assert structure.segment_ids(rows.unionByName(undated)).count() == 3


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_interpolation_equals_pandas(spark, limit):
    rng = np.random.default_rng(limit)
    values = [None if rng.random() < 0.5 else float(v) for v in rng.integers(0, 50, 60)]
    values = [None, None, *values, None, None, None, None]
    rows = series(spark, [(i, v, None, 1.0) for i, v in enumerate(values)])
    got = column(structure.interpolate_small_gaps(rows, limit), "temperature")
    want = pd.Series(values, dtype=float).interpolate(method="linear", limit=limit, limit_direction="forward")
    np.testing.assert_allclose(np.array(got, dtype=float), want.to_numpy(), equal_nan=True)
    assert column(structure.interpolate_small_gaps(rows, limit), "pressure") == [None] * len(values)


def test_strict_interpolation_fills_whole_short_runs_only(spark):
    values = [10.0, None, 12.0, None, None, None, None, 20.0, 21.0, 22.0]
    rows = series(spark, [(i, v, 1.0, 1.0) for i, v in enumerate(values)])
    got = structure.interpolate_small_gaps(rows, mode="strict")
    assert column(got, "temperature") == [10.0, 11.0, 12.0, None, None, None, None, 20.0, 21.0, 22.0]
    assert column(got, "is_interpolated")[1] and not column(got, "is_interpolated")[3]
    gap = series(spark, [(0, 1.0, 1.0, 1.0), (1, None, 1.0, 1.0), (9, 3.0, 1.0, 1.0)])
    assert column(structure.interpolate_small_gaps(gap, mode="strict"), "temperature")[1] is None


def test_external_layout(spark):
    raw = spark.createDataFrame(
        [("A", "02/01/2015 13:00", "-5.5", "980", "NA"), ("A", "junk", "1", "2", "3")],
        "station_id string, obstime string, tempr string, ap string, rh string",
    )
    rows = tables.ingest_external(raw).collect()
    assert rows[0].timestamp.month == 1 and rows[0].timestamp.day == 2 and rows[0].humidity is None
    assert rows[1].timestamp is None and rows[1].temperature == 1.0
    audit = tables.external_audit(tables.ingest_external(raw)).first()
    assert (audit.rows, audit.invalid_timestamps, audit.humidity_missing) == (2, 1, 1)


def test_manifest_detects_changes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("one")
    (tmp_path / "b.csv").write_text("two")
    before = spark.createDataFrame(tables.source_manifest(spark, str(tmp_path)).collect())
    (tmp_path / "b.csv").write_text("changed")
    (tmp_path / "c.csv").write_text("new")
    after = tables.source_manifest(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r.status for r in tables.compare_manifests(before, after).collect()}
    assert got == {"a.csv": "same", "b.csv": "changed", "c.csv": "added"}


def test_manifest_reads_files_in_pieces(spark, tmp_path):
    """Digests of an empty file, one of odd length and one of many pieces, in a folder with odd names."""
    folder = tmp_path / "a b" / "ü c"
    folder.mkdir(parents=True)
    contents = {"empty": b"", "odd": b"x" * 1001, "large": bytes(range(256)) * 20_000}
    for name, data in contents.items():
        (folder / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.sha256, r.size) for r in tables.source_manifest(spark, str(tmp_path), chunk=1000).collect()}
    assert got == {k: (hashlib.sha256(v).hexdigest(), len(v)) for k, v in contents.items()}


def test_gap_days_round_ties_to_even(spark):
    rows = series(spark, [(0, 1.0, 1.0, 1.0), (3, 1.0, 1.0, 1.0), (12, 1.0, 1.0, 1.0)])
    assert sorted(column_of(structure.time_gaps(rows), "duration_days")) == [0.12, 0.38]  # 3 / 24 and 9 / 24


def column_of(df, name):
    return [r[name] for r in df.collect()]


def test_case_window_and_lookup(spark):
    rows = series(spark, [(i, float(i), 1.0, 1.0) for i in range(20)])
    cases = spark.createDataFrame([("A", START.replace(hour=10, minute=30))], "station_id string, event_time timestamp_ntz")
    got = cleaning.case_window(rows, cases, 3)
    assert sorted(column(got, "temperature")) == [8.0, 9.0, 10.0, 11.0, 12.0, 13.0]
    asked = spark.createDataFrame(
        [("A", START.replace(hour=3)), ("A", START.replace(hour=4, second=20)), ("A", START.replace(hour=4, minute=7))],
        "station_id string, case_time timestamp_ntz",
    )
    out = cleaning.case_lookup(rows, asked, ["temperature"]).orderBy("case_time").collect()
    assert [r["match"] for r in out] == ["exact", "minute", None]


def test_order_is_global(spark):
    rows = series(spark, [(3, 3.0, 1.0, 1.0), (0, 0.0, 1.0, 1.0), (1, 1.0, 1.0, 1.0)])
    assert [r.temperature for r in structure.sort_chronological(rows).collect()] == [0.0, 1.0, 3.0]
    assert len(ordered(rows)) == 3


def test_report_has_every_part(spark):
    rows = series(spark, [(h, float(h), 1.0, None) for h in (0, 1, 5, 6, 30)])
    report = profile.quality_report(rows, rows)
    got = report.first()
    assert got.overview.cleaned_rows == 5 and got.time_gaps.total_gaps == 2
    assert [g.duration_hours for g in got.longest_gaps] == [24.0, 4.0]
    text = profile.quality_report_markdown(report).first().markdown
    assert all(f"## {heading}\n" in text for heading in profile.SECTIONS) and "| longest | 24.0 h | 1.00 d |" in text
