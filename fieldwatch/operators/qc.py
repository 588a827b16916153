"""Rule checks of the service profile: range, rate of change, flatline, missing, gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwatch.config import CHANNELS, SERVICE, Profile
from fieldwatch.functions.text import compact_texts, tie_even
from fieldwatch.timeline import Timeline, run_at_least

KEYS = ("station_id", "timestamp")


def _text(pattern: str, *cols) -> Column:
    return F.format_string(pattern, *[c.cast("double") for c in cols])


def plausibility_reason(channel: str, low: Column, high: Column) -> Column:
    """Text when the value is outside [low, high]; null when inside or missing."""
    v = F.col(channel)
    head = f"{channel}_plausibility_violation: "
    return F.when(v < low, _text(head + "%.2f < %.2f", v, low)).when(
        v > high, _text(head + "%.2f > %.2f", v, high)
    )


def plausibility(df: DataFrame, profile: Profile = SERVICE) -> DataFrame:
    """Range check per channel: `<channel>_implausible` and `<channel>_range_reason`."""
    out = {}
    for c in CHANNELS:
        low, high = (F.lit(x) for x in profile.ranges[c])
        reason = plausibility_reason(c, low, high)
        out[f"{c}_range_reason"] = reason
        out[f"{c}_implausible"] = reason.isNotNull()
    return df.withColumns(out)


def _rate(channel: str, profile_gap: Column) -> Column:
    usable = (F.col("_h") > 0) & (F.col("_h") <= profile_gap)
    return F.when(usable, F.abs(F.col(channel) - F.col(f"_p_{channel}")) / F.col("_h"))


def rate_of_change(df: DataFrame, profile: Profile = SERVICE) -> DataFrame:
    """|change| per hour; null across long gaps, on repeated times and next to a missing value."""
    tl = Timeline(df)
    out = tl.df.withColumns(
        {"_h": tl.hours(), **{f"_p_{c}": tl.lag(c) for c in CHANNELS}}
    )
    cols = {}
    for c in CHANNELS:
        rate = _rate(c, F.lit(profile.rate_gap_hours))
        cols[f"{c}_rate"] = F.round(rate, 3)
        cols[f"{c}_spike"] = F.coalesce(rate > profile.rates[c], F.lit(False))
    return tl.done(out.withColumns(cols)).drop("_h", *[f"_p_{c}" for c in CHANNELS])


def _steady(channel: str, tolerance: Column | float, gap: Column | float) -> Column:
    return (F.abs(F.col(channel) - F.col(f"_p_{channel}")) <= tolerance) & (F.col("_h") <= gap)


def _steady_runs(profile: Profile) -> dict[str, Column]:
    return {
        f"{c}_flatline": _steady(c, profile.flatline_tolerance, profile.rate_gap_hours)
        for c in CHANNELS
    }


def flatline(df: DataFrame, profile: Profile = SERVICE) -> DataFrame:
    """Flag every row of a run of at least `flatline_rows` equal readings."""
    reach = profile.flatline_rows - 1
    tl = Timeline(df, lookback=reach, lookahead=reach)
    out = tl.df.withColumns({"_h": tl.hours(), **{f"_p_{c}": tl.lag(c) for c in CHANNELS}})
    out = run_at_least(tl, out, _steady_runs(profile), profile.flatline_rows)
    return tl.done(out).drop("_h", *[f"_p_{c}" for c in CHANNELS])


def missing(df: DataFrame) -> DataFrame:
    """`missing_flag` and the names of the missing channels, in channel order."""
    names = compact_texts(*[F.when(F.col(c).isNull(), F.lit(f"{c}_missing")) for c in CHANNELS])
    return df.withColumn("missing_channels", names).withColumn(
        "missing_flag", F.size("missing_channels") > 0
    )


def time_gap(df: DataFrame, profile: Profile = SERVICE) -> DataFrame:
    tl = Timeline(df)
    out = tl.df.withColumn("hours_since_previous", tl.hours())
    return tl.done(
        out.withColumn(
            "gap_flag",
            F.coalesce(F.col("hours_since_previous") > profile.nominal_hours, F.lit(False)),
        )
    )


def overall_flag(suspect: Column, missing: Column, gap: Column) -> Column:
    return (
        F.when(suspect, "SUSPECT")
        .when(missing, "MISSING")
        .when(gap, "GAP")
        .otherwise("PASSED")
    )


def _limits(profile: Profile, thresholds: DataFrame | None) -> dict[str, Column]:
    """Limit columns: literals of the profile, overridden by a joined threshold row."""
    base = {}
    for c in CHANNELS:
        base[f"{c}_min"], base[f"{c}_max"] = (F.lit(x) for x in profile.ranges[c])
        base[f"{c}_rate_max"] = F.lit(profile.rates[c])
    if thresholds is None:
        return base
    return {
        k: F.coalesce(F.col(f"_t_{k}"), v) if k in thresholds.columns else v
        for k, v in base.items()
    }


def quality_control(
    df: DataFrame, profile: Profile = SERVICE, thresholds: DataFrame | None = None
) -> DataFrame:
    """All checks in one pass: one result row per observation, none dropped.

    thresholds: optional limits per station (`station_id` plus any of
    `<channel>_min/_max/_rate_max`); a missing row or value falls back to the profile.
    """
    reach = profile.flatline_rows - 1
    tl = Timeline(df.select(*KEYS, *CHANNELS), lookback=reach, lookahead=reach)
    out = tl.df.withColumns({"_h": tl.hours(), **{f"_p_{c}": tl.lag(c) for c in CHANNELS}})
    out = tl.done(run_at_least(tl, out, _steady_runs(profile), profile.flatline_rows))
    if thresholds is not None:
        renamed = thresholds.select(
            F.col("station_id").alias("_t_station"),
            *[F.col(c).alias(f"_t_{c}") for c in thresholds.columns if c != "station_id"],
        )
        out = out.join(renamed, F.col("station_id") == F.col("_t_station"), "left")
    return qc_result(out, profile, _limits(profile, thresholds))


def qc_result(
    out: DataFrame, profile: Profile = SERVICE, lim: dict[str, Column] | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The result columns, for rows that carry the hours since the previous row (`_h`), its
    values (`_p_<channel>`) and the flatline flags.  Shared by the batch and stream jobs.
    keep: other columns to pass on."""
    lim = lim or _limits(profile, None)
    gap = F.coalesce(F.col("_h") > profile.nominal_hours, F.lit(False))
    out = out.withColumns({f"_r_{c}": _rate(c, F.lit(profile.rate_gap_hours)) for c in CHANNELS})
    cols = {
        "missing_flag": F.col("temperature").isNull()
        | F.col("pressure").isNull()
        | F.col("humidity").isNull(),
    }
    texts = [F.when(F.col(c).isNull(), F.lit(f"{c}_missing")) for c in CHANNELS]
    texts.append(
        F.when(
            gap,
            F.concat(
                F.lit("time_gap_detected: "),
                _text("%.1f", F.col("_h")),
                F.lit(f" hrs since previous observation (> {profile.nominal_hours:.1f} hrs)"),
            ),
        )
    )
    ranged = {c: plausibility_reason(c, lim[f"{c}_min"], lim[f"{c}_max"]) for c in CHANNELS}
    texts += ranged.values()
    for c in CHANNELS:
        rate = F.col(f"_r_{c}")
        cols[f"{c}_spike"] = F.coalesce(rate > lim[f"{c}_rate_max"], F.lit(False))
        texts.append(
            F.when(
                cols[f"{c}_spike"],
                _text(
                    f"{c}_spike: step rate of %.2f/hr exceeded threshold of %.2f/hr "
                    "(delta=%.2f in %.1fh)",
                    tie_even(rate, 2),
                    lim[f"{c}_rate_max"],
                    tie_even(F.abs(F.col(c) - F.col(f"_p_{c}")), 2),
                    F.col("_h"),
                ),
            )
        )
    texts += [
        F.when(F.col(f"{c}_flatline"), F.lit(f"{c}_flatline: persistent identical readings"))
        for c in CHANNELS
    ]
    suspect = F.lit(False)
    for c in CHANNELS:
        suspect = (
            suspect | ranged[c].isNotNull() | cols[f"{c}_spike"] | F.col(f"{c}_flatline")
        )
    flag = overall_flag(suspect, cols["missing_flag"], gap)
    return out.select(
        *KEYS,
        *CHANNELS,
        flag.alias("qc_flag"),
        compact_texts(*texts).alias("qc_reasons"),
        *[cols[f"{c}_spike"].alias(f"{c}_spike") for c in CHANNELS],
        *[F.col(f"{c}_flatline") for c in CHANNELS],
        cols["missing_flag"].alias("missing_flag"),
        gap.alias("gap_flag"),
        *keep,
    )
