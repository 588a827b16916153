"""Rule checks of the hourly profile: exact one-hour steps, local-median spikes,
exact-equality flatlines, text reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwatch.config import CHANNELS, HOURLY, SPIKE_LIMIT, Profile
from fieldwatch.functions.text import joined
from fieldwatch.timeline import Timeline, micros_between, run_at_least

HOUR = 3_600_000_000
TITLES = {"temperature": "Temperature", "pressure": "Pressure", "humidity": "Humidity"}


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def range_flags(df: DataFrame, profile: Profile = HOURLY) -> DataFrame:
    return df.withColumns(
        {
            f"{c}_range_flag": _false((F.col(c) < lo) | (F.col(c) > hi))
            for c, (lo, hi) in profile.ranges.items()
        }
    )


def _with_neighbours(tl: Timeline, after: bool = False) -> DataFrame:
    cols = {"_before": micros_between(tl.lag(tl.ts), F.col(tl.ts))}
    cols.update({f"_p_{c}": tl.lag(c) for c in CHANNELS})
    if after:
        cols["_after_us"] = micros_between(F.col(tl.ts), tl.lead(tl.ts))
        cols.update({f"_n_{c}": tl.lead(c) for c in CHANNELS})
    return tl.df.withColumns(cols)


def _rate_columns(profile: Profile, gated: bool) -> dict[str, Column]:
    out = {}
    for c in CHANNELS:
        change = F.col(c) - F.col(f"_p_{c}")
        if gated:
            change = F.when(F.col("_before") == HOUR, change)
        out[f"{c}_change"] = change
        out[f"{c}_rate_flag"] = _false(F.abs(change) > profile.rates[c])
    return out


def _drop_neighbours(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(("_p_", "_n_")) or c in ("_before", "_after_us")])


def rate_flags(df: DataFrame, profile: Profile = HOURLY, gated: bool = True) -> DataFrame:
    """`<channel>_change` and its flag; gated: null unless the step is exactly one hour."""
    tl = Timeline(df)
    out = _with_neighbours(tl).withColumns(_rate_columns(profile, gated))
    return _drop_neighbours(tl.done(out))


def _median(values: Column) -> Column:
    """Median of a small array, missing values left out."""
    v = F.array_sort(F.array_compact(values))
    n = F.size(v)
    return F.when(
        n > 0,
        (
            F.element_at(v, F.floor((n + 1) / 2).cast("int"))
            + F.element_at(v, F.floor(n / 2).cast("int") + 1)
        )
        / 2,
    )


def _local_spike(limit: float) -> dict[str, Column]:
    near = F.array("_p_temperature", "temperature", "_n_temperature")
    median = F.when((F.col("_before") == HOUR) & (F.col("_after_us") == HOUR), _median(near))
    return {
        "temperature_local_median": median,
        "temperature_spike_flag": _false(F.abs(F.col("temperature") - median) > limit),
    }


def local_spike(df: DataFrame, limit: float = SPIKE_LIMIT) -> DataFrame:
    """Temperature away from the median of itself and its two hourly neighbours."""
    tl = Timeline(df, lookahead=1)
    out = _with_neighbours(tl, after=True).withColumns(_local_spike(limit))
    return _drop_neighbours(tl.done(out))


def centered_median_spike(df: DataFrame, profile: Profile = HOURLY) -> DataFrame:
    """The same for every channel by row position; null medians at ends and missing cells."""
    tl = Timeline(df, lookahead=1)
    out = _with_neighbours(tl, after=True)
    cols = {}
    for c in CHANNELS:
        a, b, d = F.col(f"_p_{c}"), F.col(c), F.col(f"_n_{c}")
        full = a.isNotNull() & b.isNotNull() & d.isNotNull()
        median = F.when(full, F.greatest(F.least(a, b), F.least(F.greatest(a, b), d)))
        cols[f"{c}_local_median"] = median
        cols[f"{c}_spike_flag"] = _false(F.abs(b - median) > profile.rates[c])
    return _drop_neighbours(tl.done(out.withColumns(cols)))


def _equal_runs() -> dict[str, Column]:
    return {f"{c}_flatline_flag": F.col(c) == F.col(f"_p_{c}") for c in CHANNELS}


def flatline_flags(df: DataFrame, profile: Profile = HOURLY) -> DataFrame:
    """Runs of exactly equal values by row position; a missing value equals nothing."""
    reach = profile.flatline_rows - 1
    tl = Timeline(df, lookback=reach, lookahead=reach)
    out = run_at_least(tl, _with_neighbours(tl), _equal_runs(), profile.flatline_rows)
    return _drop_neighbours(tl.done(out))


def gap_flag(df: DataFrame) -> DataFrame:
    tl = Timeline(df)
    return tl.done(tl.df.withColumn("gap_flag", _false(tl.hours() > 1.0)))


def reason_parts(spikes: bool) -> list[tuple[Column, str]]:
    """(flag, text) in reporting order."""
    parts = [(F.col(f"{c}_range_flag"), f"{TITLES[c]} range") for c in CHANNELS]
    parts += [(F.col(f"{c}_rate_flag"), f"{TITLES[c]} rate-of-change") for c in CHANNELS]
    if spikes:
        parts.append((F.col("temperature_spike_flag"), "Temperature spike"))
    parts += [(F.col(f"{c}_flatline_flag"), f"{TITLES[c]} flatline") for c in CHANNELS]
    return parts + [(F.col("gap_flag"), "Time gap")]


def hourly_qc(
    df: DataFrame, profile: Profile = HOURLY, gated: bool = True, spikes: bool = True
) -> DataFrame:
    """All flags, `qc_flag` (any of them) and the joined reason text, in one pass.

    gated=False, spikes=False is the batch pipeline's variant.  The change columns stay, as
    later steps need them.
    """
    reach = profile.flatline_rows - 1
    tl = Timeline(df, lookback=reach, lookahead=reach)
    out = run_at_least(tl, _with_neighbours(tl, after=True), _equal_runs(), profile.flatline_rows)
    cols = _rate_columns(profile, gated)
    if spikes:
        cols.update(_local_spike(SPIKE_LIMIT))
    cols["gap_flag"] = _false(F.col("_before") > HOUR)
    out = _drop_neighbours(tl.done(out.withColumns(cols)))
    out = range_flags(out, profile)
    parts = reason_parts(spikes)
    any_flag = parts[0][0]
    for flag, _ in parts[1:]:
        any_flag = any_flag | flag
    return out.withColumns({"qc_flag": any_flag, "qc_reasons": joined(parts, None)})
