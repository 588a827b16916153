"""Sliding windows over gap-free stretches, and the error scores computed on them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwatch.config import CHANNELS, SEQUENCE_ERROR_THRESHOLD, SEQUENCE_ROWS
from fieldwatch.ranks import quantiles
from fieldwatch.session import row_sized
from fieldwatch.timeline import Timeline, micros_between

HOUR = 3_600_000_000


def sequence_windows(
    df: DataFrame,
    rows: int = SEQUENCE_ROWS,
    max_step_hours: float = 1.5,
    exact_hour: bool = False,
    clean_flag: str | None = None,
) -> DataFrame:
    """Every window of `rows` consecutive rows without a gap or a missing value, as an array
    in time order, keyed by its last row.  exact_hour: steps must be exactly one hour.
    clean_flag: a boolean column that must be false on every row of the window."""
    tl = Timeline(df, lookback=rows - 1)
    step = micros_between(tl.lag(tl.ts), F.col(tl.ts))
    broken = (step != HOUR) if exact_hour else (step > int(max_step_hours * HOUR))
    bad = F.col("temperature").isNull() | F.col("pressure").isNull() | F.col("humidity").isNull()
    if clean_flag:
        bad = bad | F.col(clean_flag)
    marked = tl.df.withColumns(
        {"_broken": F.coalesce(broken, F.lit(False)).cast("int"), "_bad": bad.cast("int")}
    )
    whole, inner = tl.rows(rows - 1), tl.rows(rows - 2)
    marked = marked.withColumns(
        {
            "_n": F.count(F.lit(1)).over(whole),
            "_bads": F.sum("_bad").over(whole),
            "_breaks": F.sum("_broken").over(inner),
            "window": F.collect_list(F.struct(*CHANNELS)).over(whole),
        }
    )
    full = (F.col("_n") == rows) & (F.col("_bads") == 0) & (F.col("_breaks") == 0)
    return marked.where(F.col("_core") & full).select("station_id", "timestamp", "window")


def error_score(mse: Column, threshold: float = SEQUENCE_ERROR_THRESHOLD) -> Column:
    """1 - exp(-ln 2 * mse / threshold), within [0, 1]: 0.5 at the threshold."""
    raw = 1.0 - F.exp(-math.log(2.0) * mse / max(threshold, 1e-6))
    return F.when(raw < 0.0, 0.0).when(raw > 1.0, 1.0).otherwise(raw)


def flag_errors(df: DataFrame, mse: str, threshold: float = SEQUENCE_ERROR_THRESHOLD) -> DataFrame:
    return df.withColumns(
        {"sequence_flag": F.col(mse) > threshold, "sequence_score": error_score(F.col(mse), threshold)}
    )


def error_threshold(df: DataFrame, column: str, p: float = 0.99) -> DataFrame:
    """One row: the p-quantile of training errors."""
    return quantiles(df, [], column, {"threshold": p})


def spread_to_rows(windows: DataFrame, values: list[str], rows: int = SEQUENCE_ROWS) -> DataFrame:
    """Give each window's values to all its hours; the largest per hour stays."""
    hours = F.explode(
        F.sequence(
            F.col("timestamp") - F.expr(f"interval {rows - 1} hours"),
            F.col("timestamp"),
            F.expr("interval 1 hour"),
        )
    )
    spread = windows.select("station_id", hours.alias("hour"), *values)
    return (
        spread.groupBy("station_id", "hour")
        .agg(*[F.max(v).alias(v) for v in values])
        .withColumnRenamed("hour", "timestamp")
    )


def map_to_end(df: DataFrame, windows: DataFrame, values: list[str]) -> DataFrame:
    """Values of a window on its last row; null on other rows."""
    keys = ["station_id", "timestamp"]
    return df.join(row_sized(windows.select(*keys, *values)), keys, "left")
