"""Model features and scaling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwatch.config import CHANNELS, FEATURES
from fieldwatch.timeline import Timeline, micros_between

HOUR = 3_600_000_000


def _changes(tl: Timeline, fill: bool) -> dict[str, Column]:
    hourly = micros_between(tl.lag(tl.ts), F.col(tl.ts)) == HOUR
    out = {}
    for c in CHANNELS:
        change = F.when(hourly, F.col(c) - tl.lag(c))
        out[f"{c}_change"] = F.coalesce(change, F.lit(0.0)) if fill else change
    return out


def step_changes(df: DataFrame, fill: bool = True) -> DataFrame:
    """Change per channel, only over steps of exactly one hour; elsewhere 0 (fill) or null."""
    tl = Timeline(df)
    return tl.done(tl.df.withColumns(_changes(tl, fill)))


def _rolling(tl: Timeline, min_rows: int) -> dict[str, Column]:
    w = tl.rows(2)
    out = {}
    for c in CHANNELS:
        enough = F.count(c).over(w) >= min_rows
        std = F.stddev_samp(c).over(w)
        out[f"{c}_mean3"] = F.when(enough, F.avg(c).over(w))
        out[f"{c}_std3"] = F.coalesce(std, F.lit(0.0)) if min_rows == 1 else F.when(enough, std)
    return out


def rolling_3_stats(df: DataFrame, min_rows: int = 1) -> DataFrame:
    """Mean and sample deviation of the last three rows, not reset at gaps.  With
    min_rows=1 an undefined deviation is 0; with 3 both are null before the third value."""
    tl = Timeline(df, lookback=2)
    return tl.done(tl.df.withColumns(_rolling(tl, min_rows)))


def cyclic_time(df: DataFrame, days: float = 365.25) -> DataFrame:
    """Hour of day and day of year on the unit circle."""
    hour = F.hour("timestamp") * (2 * math.pi) / 24.0
    day = F.dayofyear("timestamp") * (2 * math.pi) / days
    return df.withColumns(
        {
            "hour_sin": F.sin(hour),
            "hour_cos": F.cos(hour),
            "day_sin": F.sin(day),
            "day_cos": F.cos(day),
        }
    )


def feature_table(df: DataFrame, fill: bool = True, min_rows: int = 1) -> DataFrame:
    """The sixteen features, in model order, and `valid_features` (none of them missing)."""
    tl = Timeline(df, lookback=2)
    rows = cyclic_time(tl.done(tl.df.withColumns({**_changes(tl, fill), **_rolling(tl, min_rows)})))
    valid = F.lit(True)
    for f in FEATURES:
        valid = valid & F.col(f).isNotNull()
    keep = [c for c in df.columns if c not in FEATURES]
    return rows.select(*keep, *FEATURES, valid.alias("valid_features"))


def fit_scaler(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean and population deviation of each column."""
    return train.agg(
        *[F.avg(c).alias(f"{c}__mean") for c in columns],
        *[F.stddev_pop(c).alias(f"{c}__std") for c in columns],
    )


def scale(df: DataFrame, scaler: DataFrame, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """(x - mean) / deviation; a constant column is only centred."""
    joined = df.crossJoin(F.broadcast(scaler))  # one row
    out = {}
    for c in columns:
        std = F.when(F.col(f"{c}__std") == 0, 1.0).otherwise(F.col(f"{c}__std"))
        out[f"{c}{suffix}"] = (F.col(c) - F.col(f"{c}__mean")) / std
    return joined.withColumns(out).drop(*scaler.columns)


def attribution_topk(df: DataFrame, scaler: DataFrame, columns: Sequence[str] = FEATURES, k: int = 10) -> DataFrame:
    """For each row, its k features with the largest |z|, ranked; one output row each.

    A z-score ranking in place of a tree explainer: no per-row solver.
    """
    scaled = scale(df, scaler, columns)
    pairs = F.array(
        *[
            F.struct((-F.abs(F.col(f"{c}_z"))).alias("o"), F.lit(c).alias("feature"), F.col(f"{c}_z").alias("z"))
            for c in columns
        ]
    )
    top = F.slice(F.array_sort(pairs), 1, k)
    return scaled.select("station_id", "timestamp", F.posexplode(top).alias("_i", "_t")).select(
        "station_id",
        "timestamp",
        (F.col("_i") + 1).alias("rank"),
        F.col("_t.feature").alias("feature"),
        F.col("_t.z").alias("z"),
    )


def anomaly_rates_by_split(df: DataFrame, flag: str, split: str = "split") -> DataFrame:
    hit = F.sum(F.col(flag).cast("long"))
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("rows"),
        hit.alias("anomalies"),
        F.round(hit / F.count(F.lit(1)) * 100.0, 2).alias("anomaly_pct"),
    )


