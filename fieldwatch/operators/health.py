"""Sensor health: running state per (station, parameter), and long-term indices."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwatch.config import CHANNELS
from fieldwatch.functions.text import compact_texts, round_even, tie_even
from fieldwatch.session import cut, row_sized
from fieldwatch.timeline import Timeline

SPANS = {"24h": 24, "7d": 168, "30d": 720}  # rows
STEPS_KEPT = 24
DRIFT_SLACK = 0.5
DRIFT_LIMIT = 5.0

# Words that mark a reason as belonging to a channel.
SUSPECT_WORDS = {
    "temperature": ("temp",),
    "pressure": ("press",),
    "humidity": ("humid", "rh"),
}


def parameter_suspect_flags(df: DataFrame, reasons: str = "qc_reasons") -> DataFrame:
    """`<channel>_suspect` and `<channel>_flat` from the reason texts.

    Kept as found: a missing reading's reason also marks its channel suspect.  The reasons
    are joined by line once, so that the tests are plain text searches.
    """
    df = df.withColumn("_text", F.lower(F.concat_ws("\n", reasons)))
    text, out = F.col("_text"), {}
    for c in CHANNELS:
        found = F.lit(False)
        for word in SUSPECT_WORDS[c]:
            found = found | text.contains(word)
        out[f"{c}_suspect"] = found
        out[f"{c}_flat"] = text.rlike(f"(?m)^(?=.*{c}).*flatline")
    return df.withColumns(out).drop("_text")


def series_rows(df: DataFrame) -> DataFrame:
    """One row per (observation, channel); needs the suspect flags and `missing_flag`."""
    each = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("parameter"),
                    F.col(c).alias("value"),
                    F.col(f"{c}_suspect").alias("suspect"),
                    (F.col(c).isNull() | F.col("missing_flag")).alias("missing"),
                    F.col(f"{c}_flat").alias("flat"),
                )
                for c in CHANNELS
            ]
        )
    ).alias("x")
    return df.select("station_id", "timestamp", each).select(
        F.concat_ws("|", "station_id", "x.parameter").alias("series"), "station_id", "timestamp", "x.*"
    )


def _status(index: Column, levels: tuple[float, float, float]) -> Column:
    good, fair, poor = levels
    return (
        F.when(index >= good, "HEALTHY")
        .when(index >= fair, "DEGRADING")
        .when(index >= poor, "MAINTENANCE_REQUIRED")
        .otherwise("FAILED")
    )


def _clip(x: Column) -> Column:
    return F.when(x < 0.0, 0.0).when(x > 100.0, 100.0).otherwise(x)


def _with_rates(tl: Timeline, rows: DataFrame) -> DataFrame:
    """Differences of a running count: constant work per row, not 720."""
    rows = rows.withColumns(
        {
            "_err": F.sum((F.col("suspect") | F.col("missing")).cast("long")).over(tl.upto),
            "_rn": F.row_number().over(tl.w),
        }
    )
    out = {}
    for name, n in SPANS.items():
        before = tl.lag("_err", n)
        out[f"error_rate_{name}"] = (F.col("_err") - F.coalesce(before, F.lit(0))) / F.when(
            before.isNull(), F.col("_rn")
        ).otherwise(n)
    return rows.withColumns(out).drop("_err", "_rn")


def error_rates(long: DataFrame) -> DataFrame:
    """Share of suspect or missing rows among the last 24 / 168 / 720 rows."""
    tl = Timeline(long, station="series", lookback=max(SPANS.values()))
    return tl.done(_with_rates(tl, tl.df))


def step_metrics(long: DataFrame) -> DataFrame:
    """Per row with a value: variance of the last 24 steps between values (0 with two steps
    or fewer) and the two-sided cumulative sum of steps, over rows that are not suspect."""
    seen = long.where(F.col("value").isNotNull())
    tl = Timeline(seen, station="series", lookback=STEPS_KEPT)
    rows = tl.df.withColumn("_step", F.col("value") - tl.lag("value"))
    recent = tl.rows(STEPS_KEPT - 1)
    rows = rows.withColumn(
        "noise_variance",
        F.when(F.count("_step").over(recent) > 2, F.var_pop("_step").over(recent)).otherwise(0.0),
    )
    clean = F.when(~F.col("suspect"), F.col("_step"))
    rows = tl.running_cusum(rows, {"_up": clean - DRIFT_SLACK, "_down": -clean - DRIFT_SLACK})
    return tl.done(rows).select(
        "series", "timestamp", "noise_variance", F.greatest("_up", "_down").alias("cusum_drift")
    )


def running_state(long: DataFrame) -> DataFrame:
    """Error rates, running totals (a missing row counts as missing only), the length of the
    flatline run a row is in, and `seen`: the time of the latest row with a value."""
    tl = Timeline(long, station="series", lookback=max(SPANS.values()))
    rows = _with_rates(tl, tl.df.withColumn("_pos", tl.position()))
    missing = F.col("missing").cast("long")
    suspect = (F.col("suspect") & ~F.col("missing")).cast("long")
    moving = F.when(~F.col("flat"), F.col("_pos"))
    valued = F.when(F.col("value").isNotNull(), F.col("timestamp"))
    rows = rows.withColumns(
        {
            "_lm": tl.local(F.sum, missing),
            "_ls": tl.local(F.sum, suspect),
            "_lp": tl.local(F.max, moving),
            "_lt": tl.local(F.max, valued),
        }
    )
    rows = tl.carry(
        rows,
        {
            "_cm": (F.sum(missing), F.sum),
            "_cs": (F.sum(suspect), F.sum),
            "_cp": (F.max(moving), F.max),
            "_ct": (F.max(valued), F.max),
        },
    )
    zero = F.lit(0).cast("long")
    total = F.col("_pos") + 1
    n_missing = F.coalesce("_cm", zero) + F.col("_lm")
    n_suspect = F.coalesce("_cs", zero) + F.col("_ls")
    still = F.col("_pos") - F.coalesce(F.greatest("_cp", "_lp"), F.lit(-1).cast("long"))
    rows = rows.withColumns(
        {
            "total_observations": total,
            "clean_observations": total - n_missing - n_suspect,
            "suspect_observations": n_suspect,
            "missing_observations": n_missing,
            "consecutive_flatlines": still,
            "seen": F.greatest("_ct", "_lt"),
        }
    )
    return tl.done(rows).drop("_pos", *[f"_{p}{k}" for p in "lc" for k in "mspt"])


def parameter_health(df: DataFrame) -> DataFrame:
    """The full running state, one row per (station, time, parameter).  Input: a QC result.

    The long rows feed three passes, so they are stored once first.
    """
    long = cut(series_rows(parameter_suspect_flags(df)), "health_rows")
    steps = step_metrics(long).select(
        F.col("series").alias("_s"), F.col("timestamp").alias("_t"), "noise_variance", "cusum_drift"
    )
    # A row without a value keeps the metrics of the latest row that had one.
    rows = (
        running_state(long)
        .join(row_sized(steps), (F.col("series") == F.col("_s")) & (F.col("seen") == F.col("_t")), "left")
        .drop("_s", "_t", "seen")
        .fillna(0.0, ["noise_variance", "cusum_drift"])
    )
    return with_health_index(rows)


def with_health_index(rows: DataFrame) -> DataFrame:
    """Index and status from the running metrics.  Shared by the batch and stream jobs."""
    flat, drift = F.col("consecutive_flatlines"), F.col("cusum_drift")
    penalty = (
        F.col("error_rate_24h") * 40.0
        + F.col("error_rate_7d") * 30.0
        + F.col("error_rate_30d") * 15.0
        + F.when(flat > 3, F.least(F.lit(20.0), flat * 3.0)).otherwise(0.0)
        + F.when(drift > DRIFT_LIMIT, F.least(F.lit(15.0), (drift - DRIFT_LIMIT) * 2.0)).otherwise(0.0)
    )
    index = _clip(100.0 - penalty)
    return rows.withColumn("health_index", index).withColumn(
        "status", _status(F.col("health_index"), (85.0, 60.0, 30.0))
    )


def _overall(overall: Column, lowest: Column) -> Column:
    return (
        F.when((overall >= 80.0) & (lowest >= 60.0), "OPERATIONAL")
        .when((overall >= 50.0) & (lowest >= 30.0), "DEGRADED")
        .otherwise("CRITICAL_ATTENTION")
    )


def station_health(health: DataFrame) -> DataFrame:
    """Weighted index over the channels, status and alert texts per (station, time)."""

    def of(c, field):
        return F.max(F.when(F.col("parameter") == c, F.col(field)))

    wide = health.groupBy("station_id", "timestamp").agg(
        *[of(c, "health_index").alias(f"{c}_health") for c in CHANNELS],
        *[of(c, "status").alias(f"{c}_status") for c in CHANNELS],
        *[of(c, "error_rate_24h").alias(f"_e_{c}") for c in CHANNELS],
    )
    wide = wide.withColumns(
        {f"_i_{c}": tie_even(F.col(f"{c}_health"), 1) for c in CHANNELS}
        | {f"_p_{c}": tie_even(F.col(f"_e_{c}") * 100, 1) for c in CHANNELS}
    )
    t, p, h = (F.col(f"{c}_health") for c in CHANNELS)
    overall, lowest = t * 0.4 + p * 0.4 + h * 0.2, F.least(t, p, h)
    alerts = []
    for c in CHANNELS:
        index = F.col(f"_i_{c}")
        status = F.col(f"{c}_status")
        alerts.append(
            F.when(
                status == "DEGRADING",
                F.format_string(
                    f"Sensor [{c}] degrading (Health: %.1f%%, 24h error rate: %.1f%%)",
                    index,
                    F.col(f"_p_{c}"),
                ),
            )
            .when(
                status == "MAINTENANCE_REQUIRED",
                F.format_string(f"Sensor [{c}] requires maintenance (Health: %.1f%%)", index),
            )
            .when(status == "FAILED", F.format_string(f"Sensor [{c}] has FAILED (Health: %.1f%%)", index))
        )
    return wide.select(
        "station_id",
        "timestamp",
        *[f"{c}_health" for c in CHANNELS],
        overall.alias("overall_health_index"),
        _overall(overall, lowest).alias("overall_status"),
        compact_texts(*alerts).alias("active_alerts"),
    )


# -- long-term indices over a history -----------------------------------------------------


@dataclass(frozen=True)
class HealthWeights:
    anomaly: float = 30.0
    missing: float = 25.0
    flatline: float = 20.0
    qc: float = 15.0
    trend: float = 10.0
    recent_rows: int = 24


def history_long(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """History rows per parameter: value, qc_flag, anomaly, flatline.  A channel's own
    columns (`<channel>_qc_flag`, `<channel>_anomaly`) win over the common ones."""

    def column(c, suffix, common, default):
        for name in (f"{c}_{suffix}", common):
            if name in df.columns:
                return F.col(name)
        return default

    each = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("parameter"),
                    F.col(c).alias("value"),
                    column(c, "qc_flag", "qc_flag", F.lit(None).cast("string")).alias("qc"),
                    column(c, "anomaly", "anomaly_flag", F.lit(False)).alias("anomaly"),
                    column(c, "flatline", "", F.lit(False)).alias("flat"),
                )
                for c in CHANNELS
            ]
        )
    ).alias("x")
    return df.select(*keys, "timestamp", each).select(*keys, "timestamp", "x.*")


def parameter_frequencies(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Missing, QC, flatline and anomaly frequency per parameter over the whole history."""

    def share(c):
        return F.count_if(c) / F.count(F.lit(1))

    return long.groupBy(*keys, "parameter").agg(
        F.count(F.lit(1)).alias("evaluation_window_hours"),
        share(F.col("anomaly")).alias("anomaly_frequency"),
        share(F.col("value").isNull()).alias("missing_frequency"),
        share(F.col("flat")).alias("flatline_frequency"),
        share(F.col("qc") == "SUSPECT").alias("qc_violation_rate"),
    )


def anomaly_trend(long: DataFrame, keys: Sequence[str], recent_rows: int = 24) -> DataFrame:
    """Anomaly rate of the latest rows less the overall rate, 4 dp; 0 for short histories.

    Spark applies the row limit before the shuffle, so a long history sends few rows.
    """
    by = [*keys, "parameter"]
    newest = Window.partitionBy(*by).orderBy(F.col("timestamp").desc())
    recent = (
        long.withColumn("_r", F.row_number().over(newest))
        .where(F.col("_r") <= recent_rows)
        .groupBy(*by)
        .agg(F.avg(F.col("anomaly").cast("int")).alias("_recent"), F.count(F.lit(1)).alias("_n"))
    )
    overall = long.groupBy(*by).agg(F.avg(F.col("anomaly").cast("int")).alias("_all"))
    trend = F.when(F.col("_n") >= recent_rows, round_even(F.col("_recent") - F.col("_all"), 4)).otherwise(0.0)
    return recent.join(overall, by).select(*by, trend.alias("recent_anomaly_trend"))


def longterm_health(
    df: DataFrame, weights: HealthWeights = HealthWeights(), keys: Sequence[str] = ("station_id",)
) -> DataFrame:
    """Index and status per parameter over a history, one row per key and parameter."""
    keys = list(keys)
    long = history_long(df, keys)
    by = [*keys, "parameter"]
    out = parameter_frequencies(long, keys).join(anomaly_trend(long, keys, weights.recent_rows), by)
    trend = F.col("recent_anomaly_trend")
    penalty = (
        F.col("anomaly_frequency") * weights.anomaly
        + F.col("missing_frequency") * weights.missing
        + F.col("flatline_frequency") * weights.flatline
        + F.col("qc_violation_rate") * weights.qc
        + F.when(trend > 0, trend * weights.trend).otherwise(0.0)
    )
    return out.withColumn("health_index", _clip(100.0 - penalty)).withColumn(
        "status", _status(F.col("health_index"), (85.0, 65.0, 35.0))
    )


def station_snapshot(health: DataFrame, keys: Sequence[str] = ("station_id",)) -> DataFrame:
    """Mean and lowest index over the parameters (three rows per key), status, alerts."""
    health = health.withColumns(
        {
            "_index": tie_even(F.col("health_index"), 1),
            "_trend": tie_even(F.col("recent_anomaly_trend"), 2),
        }
    )
    index, name = F.col("_index"), F.col("parameter")
    alert = (
        F.when(
            F.col("status") == "DEGRADING",
            F.format_string(
                "Sensor [%s] health degrading (Health: %.1f%%, Trend: %+.2f)",
                name, index, F.col("_trend"),
            ),
        )
        .when(
            F.col("status") == "MAINTENANCE_REQUIRED",
            F.format_string("Sensor [%s] MAINTENANCE REQUIRED (Health: %.1f%%)", name, index),
        )
        .when(F.col("status") == "FAILED", F.format_string("Sensor [%s] FAILED (Health: %.1f%%)", name, index))
    )
    place = F.array_position(F.array(*[F.lit(c) for c in CHANNELS]), name)
    rows = health.withColumn("_e", F.struct(place.alias("i"), name.alias("n"), "health_index", alert.alias("a")))
    ordered = F.array_sort("_e")
    return (
        rows.groupBy(*keys)
        .agg(
            F.avg("health_index").alias("overall_health_index"),
            F.min("health_index").alias("min_health_index"),
            F.collect_list("_e").alias("_e"),
        )
        .select(
            *keys,
            "overall_health_index",
            _overall(F.col("overall_health_index"), F.col("min_health_index")).alias("overall_status"),
            F.map_from_arrays(
                F.transform(ordered, lambda x: x["n"]), F.transform(ordered, lambda x: x["health_index"])
            ).alias("parameter_scores"),
            F.array_compact(F.transform(ordered, lambda x: x["a"])).alias("active_alerts"),
        )
    )


def hourly_health_score(df: DataFrame, keys: Sequence[str] = ("station_id",)) -> DataFrame:
    """100 - weighted shares of QC, flatline, rate, spike and gap rows, at least 0.  Input:
    the hourly profile's flags; the rate checks also serve as pressure and humidity spikes."""

    def either(*names):
        out = F.col(names[0])
        for n in names[1:]:
            out = out | F.col(n)
        return F.avg(out.cast("int")) * 100

    rates = [f"{c}_rate_flag" for c in CHANNELS]
    parts = {
        "qc_pct": either("qc_flag"),
        "flatline_pct": either(*[f"{c}_flatline_flag" for c in CHANNELS]),
        "rate_pct": either(*rates),
        "spike_pct": either("temperature_spike_flag", *rates[1:]),
        "gap_pct": either("gap_flag"),
    }
    weights = {"qc_pct": 0.40, "flatline_pct": 0.25, "rate_pct": 0.15, "spike_pct": 0.15, "gap_pct": 0.05}
    out = df.groupBy(*keys).agg(*[v.alias(k) for k, v in parts.items()])
    penalty = F.lit(0.0)
    for k, w in weights.items():
        penalty = penalty + F.col(k) * w
    return out.withColumn("health_score", F.greatest(F.lit(0.0), 100.0 - penalty))


def qc_issue_count(df: DataFrame) -> DataFrame:
    """Number of issues per row; rate checks count again as pressure and humidity spikes."""
    names = [f"{c}_rate_flag" for c in CHANNELS] + ["temperature_spike_flag"]
    names += ["pressure_rate_flag", "humidity_rate_flag"]
    names += [f"{c}_flatline_flag" for c in CHANNELS] + ["gap_flag"]
    total = F.lit(0)
    for n in names:
        total = total + F.col(n).cast("int")
    return df.withColumn("qc_issues", total)


# -- the health log -----------------------------------------------------------------------


def latest_snapshot(log: DataFrame) -> DataFrame:
    """The newest row per station, by time then id."""
    row = F.struct(*[c for c in log.columns if c != "station_id"])
    return (
        log.groupBy("station_id")
        .agg(F.max_by(row, F.struct("timestamp", "id")).alias("_r"))
        .select("station_id", "_r.*")
    )


def health_history(log: DataFrame, limit: int = 100) -> DataFrame:
    """The first `limit` rows in time order, per station and parameter (the oldest ones)."""
    w = Window.partitionBy("station_id", "parameter").orderBy("timestamp", "id")
    return log.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def latest_parameter_health(log: DataFrame) -> DataFrame:
    row = F.struct(*[c for c in log.columns if c not in ("station_id", "parameter")])
    return (
        log.groupBy("station_id", "parameter")
        .agg(F.max_by(row, F.struct("timestamp", "id")).alias("_r"))
        .select("station_id", "parameter", "_r.*")
    )


def active_health_alerts(stations: DataFrame, log: DataFrame) -> DataFrame:
    """Alerts of each station's latest snapshot; OPERATIONAL and none where it has no log."""
    latest = latest_snapshot(log).select("station_id", "overall_status", "active_alerts")
    empty = F.array().cast("array<string>")
    return stations.select("station_id").join(latest, "station_id", "left").select(
        "station_id",
        F.coalesce("overall_status", F.lit("OPERATIONAL")).alias("overall_status"),
        F.coalesce("active_alerts", empty).alias("active_alerts"),
        F.size(F.coalesce("active_alerts", empty)).alias("alert_count"),
    )
