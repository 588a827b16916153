"""Column checks, renaming, coercion and row selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwatch.config import CANONICAL_NAMES, RAW_COLUMNS, SENTINELS, TIMESTAMP_FORMATS
from fieldwatch.timeline import Timeline


def validate_columns(df: DataFrame, required: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """Return `df` unchanged, or raise with the list of columns it lacks."""
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"missing required columns: {absent}; available: {df.columns}")
    return df


def canonicalize_columns(df: DataFrame, names: dict[str, str] = CANONICAL_NAMES) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def is_sentinel(c: Column, sentinels: Sequence[float] = SENTINELS) -> Column:
    return c.isin(*[float(s) for s in sentinels])


def _numeric(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    return [c for c in (columns or numeric) if c in numeric]


def sentinels_to_null(
    df: DataFrame, columns: Sequence[str] | None = None, sentinels: Sequence[float] = SENTINELS
) -> DataFrame:
    """Sentinels and NaN become null; Spark orders NaN above every number, so it must go."""
    out = {}
    for c in _numeric(df, columns):
        v = F.col(c).cast("double")
        out[c] = F.when(~(is_sentinel(v, sentinels) | F.isnan(v)), v)
    return df.withColumns(out)


def sentinel_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: how many sentinels each column holds."""
    return df.agg(
        *[
            F.count_if(is_sentinel(F.col(c).cast("double"))).alias(c)
            for c in _numeric(df, columns)
        ]
    )


def parse_timestamp(text: Column, formats: Sequence[str] = TIMESTAMP_FORMATS) -> Column:
    """First format that reads the text; null when none does.

    Date and time texts with a fraction of a second, a zone offset or a `Z` are read as
    well; an offset is turned into the session's zone.
    """
    full = text.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d{1,9})? ?(Z|UTC|[+-]\d{2}:?\d{2})?$")
    iso = F.regexp_replace(F.regexp_replace(text, r" ?(Z|UTC)$", "+00:00"), r" ?([+-]\d{2}):?(\d{2})$", "$1:$2")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats], F.when(full, iso.try_cast("timestamp")))


def parse_timestamps(
    df: DataFrame, column: str = "timestamp", formats: Sequence[str] = TIMESTAMP_FORMATS
) -> DataFrame:
    return df.withColumn(column, parse_timestamp(F.col(column), formats))


def to_number(text: Column) -> Column:
    """Double, or null for text, NaN and infinities."""
    v = text.try_cast("double")
    return F.when(~(F.isnan(v) | (F.abs(v) == float("inf"))), v)


def numeric_coerce(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: to_number(F.col(c)) for c in columns})


def period_select(df: DataFrame, start, end, columns: Sequence[str]) -> DataFrame:
    """Rows with start <= timestamp <= end, only the named columns."""
    return df.where(F.col("timestamp").between(start, end)).select(*columns)


def split_by_date(df: DataFrame, train_end, validation_end) -> DataFrame:
    """train: before `train_end`; validation: up to before `validation_end`; test: the rest."""
    return df.withColumn(
        "split",
        F.when(F.col("timestamp") < train_end, "train")
        .when(F.col("timestamp") < validation_end, "validation")
        .otherwise("test"),
    )


def split_by_fraction(df: DataFrame, train: float = 0.70, validation: float = 0.85) -> DataFrame:
    """Chronological split per station on row numbers int(n * fraction)."""
    tl = Timeline(df, lookback=0)
    out = tl.df.withColumn("_pos", tl.position())
    out = out.withColumn(
        "split",
        F.when(F.col("_pos") < F.floor(F.col("_all") * train), "train")
        .when(F.col("_pos") < F.floor(F.col("_all") * validation), "validation")
        .otherwise("test"),
    )
    return tl.done(out.drop("_pos"))


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def with_validity(df: DataFrame, columns: Sequence[str], name: str = "valid") -> DataFrame:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    return df.withColumn(name, ok)


def case_window(df: DataFrame, cases: DataFrame, hours: int) -> DataFrame:
    """Observations within +-hours of a case of the same station.

    cases: (station_id, event_time).  Each case is spread over the 2h+2 clock hours it
    can reach, so this is an equi-join on (station, hour), not a range join.
    """
    span = F.expr(f"interval {hours} hours")
    spread = cases.select(
        "station_id",
        "event_time",
        F.explode(
            F.sequence(
                F.date_trunc("hour", F.col("event_time") - span),
                F.date_trunc("hour", F.col("event_time") + span),
                F.expr("interval 1 hour"),
            )
        ).alias("_hour"),
    )
    near = df.withColumn("_hour", F.date_trunc("hour", "timestamp")).join(
        spread, ["station_id", "_hour"]
    )
    return near.where(
        F.col("timestamp").between(F.col("event_time") - span, F.col("event_time") + span)
    ).drop("_hour")


def case_lookup(df: DataFrame, cases: DataFrame, value_columns: Sequence[str]) -> DataFrame:
    """For every case (station_id, case_time, ...): the observation at exactly that time,
    else the earliest one in the same minute; `match` says which (null: neither)."""
    exact = df.select(
        "station_id", F.col("timestamp").alias("_t"), F.struct("timestamp", *value_columns).alias("_x")
    ).groupBy("station_id", "_t").agg(F.min_by("_x", "_x").alias("_x"))
    minute = df.select(
        "station_id",
        F.date_trunc("minute", "timestamp").alias("_m"),
        F.struct("timestamp", *value_columns).alias("_y"),
    ).groupBy("station_id", "_m").agg(F.min_by("_y", "_y").alias("_y"))
    out = (
        cases.withColumn("_t", F.col("case_time"))
        .withColumn("_m", F.date_trunc("minute", "case_time"))
        .join(exact, ["station_id", "_t"], "left")
        .join(minute, ["station_id", "_m"], "left")
    )
    hit = F.coalesce("_x", "_y")
    return out.select(
        *cases.columns,
        F.when(F.col("_x").isNotNull(), "exact").when(F.col("_y").isNotNull(), "minute").alias("match"),
        hit["timestamp"].alias("matched_time"),
        *[hit[c].alias(c) for c in value_columns],
    )
