"""Profiles and reports over cleaned observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldwatch.config import CHANNELS, HOURLY, Profile
from fieldwatch.operators.structure import (
    gap_statistics_of,
    top_gaps_of,
    duplicate_count,
    missing_runs,
    segment_ids,
    time_gaps,
)
from fieldwatch.ranks import quantiles
from fieldwatch.session import cut
from fieldwatch.timeline import Timeline


def long_form(df: DataFrame, columns: Sequence[str] = CHANNELS) -> DataFrame:
    return df.unpivot("station_id", list(columns), "parameter", "value")


def missing_profile(df: DataFrame, columns: Sequence[str] = CHANNELS) -> DataFrame:
    rows, missing = F.count(F.lit(1)), F.count_if(F.col("value").isNull())
    counts = (
        long_form(df, columns)
        .groupBy("station_id", "parameter")
        .agg(
            missing.alias("missing_count"),
            F.count("value").alias("valid_count"),
            F.round(missing / rows * 100.0, 2).alias("missing_pct"),
        )
    )
    return counts.join(missing_runs(df, columns), ["station_id", "parameter"])


def missing_patterns(df: DataFrame) -> DataFrame:
    """Rows per combination of missing channels."""
    flags = [F.col(c).isNull().alias(f"{c}_missing") for c in CHANNELS]
    names = [f"{c}_missing" for c in CHANNELS]
    total = F.col(names[0]).cast("int") + F.col(names[1]).cast("int") + F.col(names[2]).cast("int")
    return (
        df.groupBy("station_id", *flags)
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn(
            "kind",
            F.when(total == 0, "all_present").when(total == 3, "all_missing").otherwise("some_missing"),
        )
    )


def parameter_statistics(df: DataFrame, columns: Sequence[str] = CHANNELS) -> DataFrame:
    """Count, range, mean, spread and quartiles, 2 dp; zeros for an all-missing column."""
    rows = long_form(df, columns)
    keys = ["station_id", "parameter"]
    basic = rows.groupBy(*keys).agg(
        F.count("value").alias("count"),
        F.round(F.min("value"), 2).alias("min"),
        F.round(F.max("value"), 2).alias("max"),
        F.round(F.avg("value"), 2).alias("mean"),
        F.round(F.stddev_samp("value"), 2).alias("std"),
    )
    q = quantiles(rows, keys, "value", {"a": 0.25, "b": 0.5, "c": 0.75}).select(
        *keys,
        F.round("a", 2).alias("q25"),
        F.round("b", 2).alias("median"),
        F.round("c", 2).alias("q75"),
        F.round(F.col("c") - F.col("a"), 2).alias("iqr"),
    )
    out = basic.join(q, keys, "left")
    return out.fillna(0.0, [c for c in out.columns if c not in (*keys, "count")])


def describe_channels(df: DataFrame, columns: Sequence[str] = CHANNELS) -> DataFrame:
    """The describe() table of each channel over all stations."""
    rows = long_form(df, columns)
    basic = rows.groupBy("parameter").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    q = quantiles(rows, ["parameter"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return basic.join(q, "parameter", "left")


def range_violation_counts(df: DataFrame, profile: Profile = HOURLY) -> DataFrame:
    """Counts below and above each limit, per station."""
    out = []
    for c in CHANNELS:
        low, high = profile.ranges[c]
        out.append(F.count_if(F.col(c) < low).alias(f"{c}_below"))
        out.append(F.count_if(F.col(c) > high).alias(f"{c}_above"))
    return df.groupBy("station_id").agg(*out)


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n largest values of a channel over all stations."""
    return df.orderBy(F.desc_nulls_last(column), "station_id", "timestamp").limit(n)


def around_maximum(df: DataFrame, column: str, rows: int = 5) -> DataFrame:
    """Rows at most `rows` rows away from each station's first maximum of `column`."""
    tl = Timeline(df, lookback=0)
    placed = tl.done(tl.df.withColumn("_pos", tl.position()))
    peak = (
        placed.where(F.col(column).isNotNull())
        .groupBy("station_id")
        .agg(F.max_by(F.struct("_pos"), F.struct(F.col(column), -F.col("_pos"))).alias("_peak"))
        .select(
            "station_id",
            F.explode(F.sequence(F.lit(-rows), F.lit(rows))).alias("offset"),
            F.col("_peak._pos").alias("_center"),
        )
        .select("station_id", "offset", (F.col("_center") + F.col("offset")).alias("_pos"))
    )
    return placed.join(peak, ["station_id", "_pos"]).drop("_pos")


def quality_report(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """One nested row per station: overview, missing values, gaps, longest gaps, statistics.

    raw: rows before de-duplication; clean: the working rows.  The working rows and their
    gaps feed several parts, so they are stored first.
    """
    keyed = ["station_id"]
    clean = cut(clean, "clean")
    found = cut(time_gaps(clean), "gaps")
    overview = (
        segment_ids(clean.select("station_id", "timestamp"))
        .groupBy("station_id")
        .agg(
            F.count(F.lit(1)).alias("cleaned_rows"),
            F.min("timestamp").alias("date_start"),
            F.max("timestamp").alias("date_end"),
            (F.max("segment_id") + 1).alias("continuous_segments"),
        )
        .join(raw.groupBy("station_id").agg(F.count(F.lit(1)).alias("raw_rows")), keyed)
        .join(duplicate_count(raw), keyed)
    )

    def nested(frame: DataFrame, name: str, order: str) -> DataFrame:
        cols = [order] + [c for c in frame.columns if c not in ("station_id", order)]
        return frame.groupBy("station_id").agg(
            F.array_sort(F.collect_list(F.struct(*cols))).alias(name)
        )

    gaps = gap_statistics_of(clean.select("station_id").distinct(), found, 1.0)
    gaps = gaps.select(
        "station_id", F.struct(*[c for c in gaps.columns if c != "station_id"]).alias("time_gaps")
    )
    return (
        overview.select(
            "station_id",
            F.struct(*[c for c in overview.columns if c != "station_id"]).alias("overview"),
        )
        .join(nested(missing_profile(clean), "missing_values", "parameter"), keyed)
        .join(gaps, keyed)
        .join(nested(top_gaps_of(found, 10), "longest_gaps", "rank"), keyed, "left")
        .join(nested(parameter_statistics(clean), "parameter_statistics", "parameter"), keyed)
    )


# The section headings of the Markdown report.
SECTIONS = (
    "Dataset Overview & Chronology",
    "Missing Value Analysis",
    "Time Gap Detection & Duration Profiling",
    "Parameter Statistical Distributions",
)


def quality_report_markdown(report: DataFrame) -> DataFrame:
    """The report as Markdown text, one row per station."""

    def num(c, pattern="%.1f"):
        return F.format_string(pattern, c)

    def rows(array, cell):
        return F.array_join(F.transform(array, cell), "\n")

    o, g = F.col("overview"), F.col("time_gaps")
    gap_lines = [
        F.concat(
            F.lit(f"| {label} | "), num(g[field]), F.lit(" h | "), num(g[field] / 24.0, "%.2f"), F.lit(" d |")
        )
        for label, field in (
            ("shortest", "min_gap_hours"),
            ("median", "median_gap_hours"),
            ("mean", "mean_gap_hours"),
            ("nine in ten below", "p90_gap_hours"),
            ("longest", "max_gap_hours"),
            ("all together", "total_missing_hours"),
        )
    ]

    def bar(*cells):
        return F.concat(F.lit("| "), F.concat_ws(" | ", *[c.cast("string") for c in cells]), F.lit(" |"))

    lines = [
        F.concat(F.lit("# Report for station "), F.col("station_id")),
        F.lit(f"## {SECTIONS[0]}"),
        F.lit("| what | value |\n|---|---|"),
        bar(F.lit("rows read"), F.format_number(o["raw_rows"], 0)),
        bar(F.lit("rows kept"), F.format_number(o["cleaned_rows"], 0)),
        bar(F.lit("first observation"), o["date_start"]),
        bar(F.lit("last observation"), o["date_end"]),
        bar(F.lit("repeated times"), o["duplicates"]),
        bar(F.lit("stretches without a gap"), o["continuous_segments"]),
        F.lit(f"## {SECTIONS[1]}"),
        F.lit("| channel | present | missing | share missing | longest run missing |\n|---|--:|--:|--:|--:|"),
        rows(
            F.col("missing_values"),
            lambda m: bar(m["parameter"], m["valid_count"], m["missing_count"], F.concat(m["missing_pct"].cast("string"), F.lit("%")), m["max_consecutive_missing"]),
        ),
        F.lit(f"## {SECTIONS[2]}"),
        F.concat(F.lit("Steps of more than an hour: "), F.format_number(g["total_gaps"], 0)),
        F.lit("| gaps | hours | days |\n|---|--:|--:|"),
        *gap_lines,
        F.lit("### Longest gaps"),
        F.lit("| no. | from | to | hours | days | rows missing |\n|--:|---|---|--:|--:|--:|"),
        F.coalesce(
            rows(
                F.col("longest_gaps"),
                lambda x: bar(x["gap_id"], x["gap_start"], x["gap_end"], num(x["duration_hours"]), num(x["duration_days"]), x["missing_steps"]),
            ),
            F.lit(""),
        ),
        F.lit(f"## {SECTIONS[3]}"),
        F.lit("| channel | n | least | lower quartile | median | mean | upper quartile | most | deviation |\n|---|--:|--:|--:|--:|--:|--:|--:|--:|"),
        rows(
            F.col("parameter_statistics"),
            lambda s: bar(*[s[f] for f in ("parameter", "count", "min", "q25", "median", "mean", "q75", "max", "std")]),
        ),
    ]
    return report.select("station_id", F.concat_ws("\n", *lines).alias("markdown"))


def qc_summary(qc: DataFrame) -> DataFrame:
    """Per station: rows per flag and how often each detector fired."""
    flags = [
        F.count_if(F.col("qc_flag") == f).alias(f"flag_{f.lower()}")
        for f in ("PASSED", "SUSPECT", "MISSING", "GAP")
    ]
    detectors = [f"{c}_{k}" for k in ("spike", "flatline") for c in CHANNELS] + [
        "missing_flag",
        "gap_flag",
    ]
    return qc.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("rows"), *flags, *[F.count_if(F.col(d)).alias(d) for d in detectors]
    )
