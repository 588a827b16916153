"""Time structure of station series: order, duplicates, gaps, segments, filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldwatch.config import CHANNELS, SEQUENCE_ROWS
from fieldwatch.functions.text import round_even
from fieldwatch.ranks import quantiles
from fieldwatch.session import cut
from fieldwatch.timeline import Timeline, hours_between, run_at_least

HOUR_MICROS = 3_600_000_000


def sort_chronological(df: DataFrame) -> DataFrame:
    """Global order by station and time; range-partitioned, so it scales with the cluster."""
    return df.orderBy("station_id", F.col("timestamp").asc_nulls_last())


def duplicate_audit(df: DataFrame) -> DataFrame:
    """All rows that share (station, timestamp) with another row.

    Counting first (partial aggregation) means a time stamp repeated millions of times
    is one row on the counting side, and the rows themselves are never gathered.
    """
    keys = ["station_id", "timestamp"]
    repeated = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    ).select(F.col("station_id").alias("_s"), F.col("timestamp").alias("_t"), "copies")
    return df.join(
        repeated,
        F.col("station_id").eqNullSafe(F.col("_s")) & F.col("timestamp").eqNullSafe(F.col("_t")),
    ).drop("_s", "_t")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Per station: rows beyond the first of each timestamp."""
    per_time = df.groupBy("station_id", "timestamp").agg(F.count(F.lit(1)).alias("n"))
    return per_time.groupBy("station_id").agg(F.sum(F.col("n") - 1).alias("duplicates"))


def dedup_timestamps(df: DataFrame, order: str, keep: str = "first") -> DataFrame:
    """One row per (station, timestamp): the first or last by `order`; "none" drops
    every timestamp that occurs more than once.  A partial aggregate, not a window."""
    keys = ["station_id", "timestamp"]
    row = F.struct(*[c for c in df.columns if c not in keys])
    pick = F.max_by(row, F.col(order)) if keep == "last" else F.min_by(row, F.col(order))
    out = df.groupBy(*keys).agg(pick.alias("_row"), F.count(F.lit(1)).alias("_n"))
    if keep == "none":
        out = out.where(F.col("_n") == 1)
    return out.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def time_gaps(df: DataFrame, nominal_hours: float = 1.0) -> DataFrame:
    """One row per step longer than the nominal interval."""
    tl = Timeline(df.select("station_id", "timestamp"))
    rows = tl.df.withColumn("_h", tl.hours()).withColumn("gap_start", tl.lag("timestamp"))
    rows = rows.withColumn("_pos", tl.position())
    is_gap = (F.col("_h") > nominal_hours).cast("long")
    rows = tl.running_sum(rows, {"gap_id": is_gap})
    gaps = rows.where(F.col("_h") > nominal_hours)
    hours = round_even(F.col("_h"), 2)
    return gaps.select(
        "station_id",
        "gap_id",
        (F.col("_pos") - 1).alias("row_index_before"),
        F.col("_pos").alias("row_index_after"),
        "gap_start",
        F.col("timestamp").alias("gap_end"),
        hours.alias("duration_hours"),
        round_even(hours / 24.0, 2).alias("duration_days"),
        (F.bround(hours / nominal_hours).cast("long") - 1).alias("missing_steps"),
    )


def gap_statistics(df: DataFrame, nominal_hours: float = 1.0) -> DataFrame:
    """Per station; zeros where a station has no gap."""
    gaps = cut(time_gaps(df, nominal_hours), "gaps")
    return gap_statistics_of(df.select("station_id").distinct(), gaps, nominal_hours)


def gap_statistics_of(stations: DataFrame, gaps: DataFrame, nominal_hours: float) -> DataFrame:
    d = F.col("duration_hours")
    basic = gaps.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("total_gaps"),
        F.min(d).alias("min_gap_hours"),
        F.max(d).alias("max_gap_hours"),
        round_even(F.avg(d), 2).alias("mean_gap_hours"),
        round_even(F.sum(d) - F.count(F.lit(1)) * nominal_hours, 1).alias("total_missing_hours"),
    )
    q = quantiles(gaps, ["station_id"], "duration_hours", {"median_gap_hours": 0.5, "p90": 0.9})
    q = q.withColumn("p90_gap_hours", round_even(F.col("p90"), 2)).drop("p90")
    out = stations.join(basic, "station_id", "left").join(q, "station_id", "left")
    zeros = {c: 0 if c == "total_gaps" else 0.0 for c in out.columns if c != "station_id"}
    return out.fillna(zeros)


def top_gaps(df: DataFrame, n: int = 10, nominal_hours: float = 1.0) -> DataFrame:
    """The n longest gaps of every station."""
    return top_gaps_of(time_gaps(df, nominal_hours), n)


def top_gaps_of(gaps: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("station_id").orderBy(F.desc("duration_hours"), "gap_start")
    return (
        gaps.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= n)
    )


def segment_ids(df: DataFrame, max_step_hours: float = 1.0) -> DataFrame:
    """`segment_id`: number of steps longer than `max_step_hours` so far, from 0."""
    tl = Timeline(df)
    rows = tl.df.withColumn("_h", tl.hours())
    rows = tl.running_sum(rows, {"segment_id": (F.col("_h") > max_step_hours).cast("long")})
    return tl.done(rows).drop("_h")


def segment_ids_strict(df: DataFrame) -> DataFrame:
    """A segment opens at every step that is not exactly one hour, and at the first row."""
    tl = Timeline(df)
    rows = tl.df.withColumn("_h", tl.hours())
    opens = F.coalesce(F.col("_h") != 1.0, F.lit(True)).cast("long")
    return tl.done(tl.running_sum(rows, {"segment_id": opens})).drop("_h")


def complete_segments(df: DataFrame, min_rows: int = SEQUENCE_ROWS) -> DataFrame:
    """Rows of segments of at least `min_rows` rows; a segment opens at a row with a missing
    channel and at every step that is not exactly one hour."""
    reach = min_rows - 1
    tl = Timeline(df, lookback=reach, lookahead=reach)
    rows = tl.df.withColumn("_h", tl.hours())
    complete = F.lit(True)
    for c in CHANNELS:
        complete = complete & F.col(c).isNotNull()
    rows = rows.withColumn("_open", ~complete | F.coalesce(F.col("_h") != 1.0, F.lit(True)))
    rows = run_at_least(tl, rows, {"_long": ~F.col("_open")}, min_rows)
    rows = tl.running_sum(rows, {"segment_id": F.col("_open").cast("long")})
    return tl.done(rows.where("_long")).drop("_h", "_open", "_long")


def segment_catalog(segments: DataFrame, n: int = 10) -> DataFrame:
    """The n largest segments per station, with the station's totals."""
    per = segments.groupBy("station_id", "segment_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("timestamp").alias("start"),
        F.max("timestamp").alias("end"),
    )
    w = Window.partitionBy("station_id").orderBy(F.desc("rows"), "start")
    totals = per.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("segments"), F.sum("rows").alias("eligible_rows")
    )
    return (
        per.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= n)
        .join(totals, "station_id")
    )


def interpolate_small_gaps(
    df: DataFrame,
    max_gap_hours: float = 2.0,
    columns: Sequence[str] = CHANNELS,
    mode: str = "compat",
    nominal_hours: float = 1.0,
) -> DataFrame:
    """Linear fill of missing values by row position; adds `is_interpolated`.

    compat: the first `int(max_gap_hours)` cells of every run, also of longer ones; after
    the last value that value is carried.  strict: only whole runs of at most that many
    cells whose neighbours are adjacent in time.
    """
    limit = int(max_gap_hours)
    tl = Timeline(df, lookback=limit)
    rows = tl.df.withColumn("_rn", F.row_number().over(tl.w)).withColumn("_pos", tl.position())
    back = Window.partitionBy(tl.station, "_blk").orderBy(F.col("_rn").desc())
    before = tl.w.rowsBetween(-limit, 0)
    ahead = back.rowsBetween(Window.unboundedPreceding, 0)
    carried = {}
    for i, c in enumerate(columns):
        here = F.when(F.col(c).isNotNull(), F.struct("_rn", F.col(c).alias("v"), F.col("timestamp").alias("t")))
        glob = F.when(F.col(c).isNotNull(), F.struct(F.col("_pos").alias("_rn"), F.col(c).alias("v"), F.col("timestamp").alias("t")))
        rows = rows.withColumn(f"_b{i}", F.last(here, ignorenulls=True).over(before))
        rows = rows.withColumn(f"_a{i}", F.last(here, ignorenulls=True).over(ahead))
        carried[f"_n{i}"] = (F.min(glob), lambda x: F.last(x, ignorenulls=True))
    rows = tl.carry(rows, carried, backward=True)
    filled = F.lit(False)
    out = {}
    for i, c in enumerate(columns):
        prev, near, far = F.col(f"_b{i}"), F.col(f"_a{i}"), F.col(f"_n{i}")
        k = F.col("_rn") - prev["_rn"]
        to_next = F.coalesce(near["_rn"] - F.col("_rn"), far["_rn"] - F.col("_pos"))
        next_v = F.coalesce(near["v"], far["v"])
        next_t = F.coalesce(near["t"], far["t"])
        ok = F.col(c).isNull() & prev.isNotNull() & (k <= limit)
        value = F.when(to_next.isNull(), prev["v"]).otherwise(
            prev["v"] + (next_v - prev["v"]) * k / (k + to_next)
        )
        if mode == "strict":
            run = k + to_next
            ok = ok & (run - 1 <= limit) & (hours_between(prev["t"], next_t) <= run * nominal_hours)
        ok = F.coalesce(ok, F.lit(False))
        out[c] = F.when(ok, value).otherwise(F.col(c))
        filled = filled | ok
    rows = rows.withColumn("is_interpolated", filled).withColumns(out)
    drop = [f"_{p}{i}" for p in "ban" for i in range(len(columns))] + ["_pos"]
    return tl.done(rows.drop(*drop))


def missing_runs(df: DataFrame, columns: Sequence[str] = CHANNELS) -> DataFrame:
    """Per station and parameter: the longest run of consecutive missing values."""
    tl = Timeline(df.select("station_id", "timestamp", *columns), lookback=0)
    rows = tl.df.withColumn("_pos", tl.position())
    rows = tl.running_max(
        rows, {f"_seen_{c}": F.when(F.col(c).isNotNull(), F.col("_pos")) for c in columns}
    )
    longest = [
        F.max(
            F.when(F.col(c).isNull(), F.col("_pos") - F.coalesce(F.col(f"_seen_{c}"), F.lit(-1)))
        ).alias(c)
        for c in columns
    ]
    wide = rows.groupBy("station_id").agg(*[F.coalesce(x, F.lit(0)).alias(c) for x, c in zip(longest, columns)])
    return wide.unpivot("station_id", list(columns), "parameter", "max_consecutive_missing")


def interval_distribution(df: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent step lengths of every station, with its median and longest step."""
    tl = Timeline(df.select("station_id", "timestamp"))
    steps = tl.done(tl.df.withColumn("step_hours", tl.hours())).where(F.col("step_hours").isNotNull())
    counts = steps.groupBy("station_id", "step_hours").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("station_id").orderBy(F.desc("n"), "step_hours")
    longest = counts.groupBy("station_id").agg(F.max("step_hours").alias("max_step_hours"))
    median = quantiles(counts, ["station_id"], "step_hours", {"median_step_hours": 0.5}, "n")
    return (
        counts.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= n)
        .join(longest, "station_id")
        .join(median, "station_id")
    )


def latest_trend(df: DataFrame, n: int = 24) -> DataFrame:
    """The latest n rows of every station with the temperature range among them.

    Spark limits `row_number() <= n` before the shuffle, so each task ships at most n
    rows per station.
    """
    newest = Window.partitionBy("station_id").orderBy(F.col("timestamp").desc())
    rows = df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n)
    span = Window.partitionBy("station_id")
    return rows.withColumns(
        {
            "min_temperature": F.min("temperature").over(span),
            "max_temperature": F.max("temperature").over(span),
        }
    ).drop("_rn")
