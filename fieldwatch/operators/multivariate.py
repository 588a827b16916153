"""Joint consistency of temperature, pressure and humidity changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwatch.config import CHANNELS
from fieldwatch.operators.features import fit_scaler, scale
from fieldwatch.ranks import quantiles
from fieldwatch.session import row_sized
from fieldwatch.timeline import Timeline

CHANGES = tuple(f"{c}_change" for c in CHANNELS)
LIMIT = 3.0


def _norm(columns) -> Column:
    total = F.lit(0.0)
    for c in columns:
        total = total + F.col(c) * F.col(c)
    return F.sqrt(total)


def _flag(score: str, limit) -> Column:
    return F.coalesce(F.col(score) > limit, F.lit(False))


def multivariate_batch(df: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Length of the z-vector of the changes, against the station's own mean and sample
    deviation.  The statistics are a group-by, so no station is gathered in one task."""
    stats = df.groupBy(F.col("station_id").alias("_s")).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in CHANGES],
        *[F.stddev_samp(c).alias(f"_d_{c}") for c in CHANGES],
    )
    out = df.join(row_sized(stats), F.col("station_id").eqNullSafe(F.col("_s")))
    out = out.withColumns(
        {f"{c}_z": (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_d_{c}"), F.lit(0.0)) for c in CHANGES}
    ).withColumn("multivariate_score", _norm(f"{c}_z" for c in CHANGES))
    out = out.withColumn("multivariate_anomaly", _flag("multivariate_score", limit))
    return out.drop("_s", *[f"_{p}_{c}" for p in "md" for c in CHANGES])


def multivariate_expanding(df: DataFrame, qc_flag: str | None = "qc_flag", limit: float = LIMIT) -> DataFrame:
    """z of the latest change against all changes up to and including it.

    Null before the third row and once any channel was missing in the history; rows whose
    QC flag is PASSED are not evaluated.  Moments are kept per block and merged.
    """
    tl = Timeline(df)
    rows = tl.df.withColumns({f"_x{i}": F.col(c) - tl.lag(c) for i, c in enumerate(CHANNELS)})
    gone = F.col("temperature").isNull() | F.col("pressure").isNull() | F.col("humidity").isNull()
    local, aggs = {"_pos": tl.position(), "_hole": tl.local(F.sum, gone.cast("long"))}, {}
    aggs["_c_hole"] = (F.sum(gone.cast("long")), F.sum)
    for i in range(len(CHANNELS)):
        x = F.col(f"_x{i}")
        n, mean = F.count(x), F.avg(x)
        square = F.coalesce(F.var_pop(x) * n + n * mean * mean, F.lit(0.0))
        local[f"_n{i}"] = tl.local(F.count, x)
        local[f"_a{i}"] = tl.local(F.avg, x)
        local[f"_v{i}"] = tl.local(F.var_pop, x)
        aggs[f"_c_n{i}"] = (n, F.sum)
        aggs[f"_c_s{i}"] = (F.coalesce(F.sum(x), F.lit(0.0)), F.sum)
        aggs[f"_c_q{i}"] = (square, F.sum)
    rows = tl.carry(rows.withColumns(local), aggs)
    total = F.lit(0.0)
    for i in range(len(CHANNELS)):
        na = F.coalesce(F.col(f"_c_n{i}"), F.lit(0))
        sa, qa = F.coalesce(F.col(f"_c_s{i}"), F.lit(0.0)), F.coalesce(F.col(f"_c_q{i}"), F.lit(0.0))
        nb, mb = F.col(f"_n{i}"), F.coalesce(F.col(f"_a{i}"), F.lit(0.0))
        n = na + nb
        ma = F.when(na > 0, sa / na).otherwise(0.0)
        m2 = (
            F.when(na > 0, qa - na * ma * ma).otherwise(0.0)
            + F.coalesce(F.col(f"_v{i}"), F.lit(0.0)) * nb
            + F.when(n > 0, (mb - ma) * (mb - ma) * na * nb / n).otherwise(0.0)
        )
        mean = F.when(n > 0, (na * ma + nb * mb) / n)
        std = F.sqrt(F.when(n > 1, F.greatest(m2, F.lit(0.0)) / (n - 1)))
        z = F.when(std > 1e-12, (F.col(f"_x{i}") - mean) / std).otherwise(0.0)
        total = total + z * z
    usable = (F.col("_pos") >= 2) & (F.coalesce(F.col("_c_hole"), F.lit(0)) + F.col("_hole") == 0)
    if qc_flag is not None:
        usable = usable & (F.col(qc_flag) != "PASSED")
    rows = rows.withColumn("multivariate_score", F.when(usable, F.sqrt(total)))
    rows = rows.withColumn("multivariate_anomaly", _flag("multivariate_score", limit))
    return tl.done(rows).select(*df.columns, "multivariate_score", "multivariate_anomaly")


def fit_changes(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scaler of the training rows' changes, and the 99th percentile of their scores: one row each."""
    scaler = fit_scaler(train.dropna(subset=list(CHANGES)), CHANGES)
    return scaler, quantiles(_scored(train, scaler), [], "multivariate_score", {"threshold": 0.99})


def _scored(rows: DataFrame, scaler: DataFrame) -> DataFrame:
    scaled = scale(rows.fillna(0.0, list(CHANGES)), scaler, CHANGES)
    return scaled.withColumn("multivariate_score", _norm(f"{c}_z" for c in CHANGES))


def score_changes(df: DataFrame, scaler: DataFrame, cut: DataFrame) -> DataFrame:
    """Missing changes count as 0; the flag is a score above the fitted percentile."""
    return (
        _scored(df, scaler)
        .crossJoin(F.broadcast(cut))  # one row
        .withColumn("multivariate_anomaly", F.col("multivariate_score") > F.col("threshold"))
    )


def multivariate_trained(df: DataFrame, train_flag: str = "is_train") -> DataFrame:
    """Scaler fitted on the training rows' changes, missing changes 0, flag above the 99th
    percentile of the training rows' scores.  train_flag: boolean column.

    `df` is read three times; pass a stored table, or `session.cut` it first.
    """
    return score_changes(df, *fit_changes(df.where(F.col(train_flag))))


def multivariate_l1(df: DataFrame, reference: DataFrame, threshold: float) -> DataFrame:
    """Sum of |change| / sample deviation of the reference changes, against a threshold."""
    stats = reference.agg(*[F.stddev_samp(c).alias(f"_d_{c}") for c in CHANGES])
    total = F.lit(0.0)
    for c in CHANGES:
        total = total + F.abs(F.col(c) / F.col(f"_d_{c}"))
    return (
        df.crossJoin(F.broadcast(stats))  # one row
        .withColumn("multivariate_score", total)
        .withColumn("multivariate_anomaly", _flag("multivariate_score", threshold))
        .drop(*stats.columns)
    )
