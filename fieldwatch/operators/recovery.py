"""Estimates for flagged readings, beside the untouched observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwatch.config import CHANNELS
from fieldwatch.functions.text import parameter_unit
from fieldwatch.timeline import Timeline, micros_between

HOUR = 3_600_000_000

# Method names and texts.
METHOD = "Temporal neighbor interpolation"
NEIGHBOR = "Neighbor interpolation"
DONE = "Recovery computed successfully via linear temporal neighbor interpolation."
NO_NEIGHBORS = "Recovery not applicable — valid temporal neighbors are unavailable for this observation."
BAD_NEIGHBORS = "Recovery not applicable — neighbor values are invalid for this parameter."
NOT_FLAGGED = "Recovery not applicable — observation is normal."
NO_VALUE = "Recovery not applicable — parameter is not flagged as anomalous."
HOURLY_TEXTS = {
    "edge": "Recovery unavailable: neighboring observations missing",
    "step": "Recovery unavailable: non-continuous hourly observations",
    "done": "Estimated using previous and next continuous hourly observations",
    "none": "Recovery unavailable: valid neighboring values not available for affected parameters",
}


def _around(df: DataFrame) -> tuple[Timeline, DataFrame]:
    tl = Timeline(df, lookahead=1)
    cols = {"_pt": tl.lag(tl.ts), "_nt": tl.lead(tl.ts)}
    for c in CHANNELS:
        cols[f"_p_{c}"], cols[f"_n_{c}"] = tl.lag(c), tl.lead(c)
    return tl, tl.df.withColumns(cols)


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def recover_neighbors(df: DataFrame, flagged: str, parameters: str) -> DataFrame:
    """One row per (observation, parameter in the array column `parameters`): mean of the
    previous and next row's value.  Not tested for adjacency in time; a neighbour of -100
    or less counts as invalid."""
    tl, rows = _around(df)
    return neighbor_estimates(tl.done(rows), flagged, parameters)


def neighbor_estimates(rows: DataFrame, flagged: str, parameters: str) -> DataFrame:
    """The same for rows that carry their neighbours' times (`_pt`, `_nt`) and values
    (`_p_<channel>`, `_n_<channel>`).  Shared by the batch and stream jobs."""
    choices = F.array(
        *[
            F.struct(
                F.lit(c).alias("parameter"),
                F.col(c).alias("value"),
                F.col(f"_p_{c}").alias("before"),
                F.col(f"_n_{c}").alias("after"),
            )
            for c in CHANNELS
        ]
    )
    rows = rows.withColumn(
        "_c", F.explode(F.filter(choices, lambda x: F.array_contains(F.col(parameters), x["parameter"])))
    )
    c = F.col("_c")
    wanted = c["value"].isNotNull() & F.col(flagged)
    both = c["before"].isNotNull() & c["after"].isNotNull()
    valid = both & (c["before"] > -100) & (c["after"] > -100)
    ok = wanted & valid
    return rows.select(
        "station_id",
        "timestamp",
        c["parameter"].alias("parameter"),
        c["value"].alias("observed_value"),
        F.when(ok, (c["before"] + c["after"]) / 2.0).alias("estimated_value"),
        parameter_unit(c["parameter"]).alias("unit"),
        F.when(ok, "AVAILABLE").otherwise("NOT_APPLICABLE").alias("recovery_status"),
        F.when(ok, METHOD).alias("recovery_method"),
        F.when(ok, _iso(F.col("_pt"))).alias("previous_timestamp"),
        F.when(ok, _iso(F.col("_nt"))).alias("next_timestamp"),
        F.when(~F.col(flagged), NOT_FLAGGED)
        .when(c["value"].isNull(), NO_VALUE)
        .when(ok, DONE)
        .when(both, BAD_NEIGHBORS)
        .otherwise(NO_NEIGHBORS)
        .alias("message"),
    )


def recover_hourly(df: DataFrame, anomaly: str = "final_anomaly") -> DataFrame:
    """Estimates on anomalous rows whose neighbours are exactly one hour away, only for the
    channels attributed (`<channel>_anomaly`)."""
    tl, rows = _around(df)
    rows = tl.done(rows)
    edge = F.col("_pt").isNull() | F.col("_nt").isNull()
    hourly = (micros_between(F.col("_pt"), F.col("timestamp")) == HOUR) & (
        micros_between(F.col("timestamp"), F.col("_nt")) == HOUR
    )
    here = F.col(anomaly) & F.coalesce(hourly, F.lit(False))
    est, names, any_done = {}, [], F.lit(False)
    for c in CHANNELS:
        value = (F.col(f"_p_{c}") + F.col(f"_n_{c}")) / 2
        e = F.when(here & F.col(f"{c}_anomaly"), value)
        est[f"estimated_{c}"] = e
        names.append(F.when(e.isNotNull(), c.upper()))
        any_done = any_done | e.isNotNull()
    reason = F.when(
        F.col(anomaly),
        F.when(edge, HOURLY_TEXTS["edge"])
        .when(~hourly, HOURLY_TEXTS["step"])
        .when(any_done, HOURLY_TEXTS["done"])
        .otherwise(HOURLY_TEXTS["none"]),
    )
    out = rows.withColumns(
        {
            **est,
            "recovery_method": F.when(any_done, NEIGHBOR),
            "recovery_parameters": F.when(any_done, F.concat_ws(", ", *names)).otherwise("None"),
            "recovery_available": any_done,
            "recovery_reason": reason,
        }
    )
    return out.drop("_pt", "_nt", *[f"_{s}_{c}" for s in "pn" for c in CHANNELS])


def recover_fault_isolated(df: DataFrame, classification: str, isolated: str) -> DataFrame:
    """Temperature only, where the row is a fault and an isolated event."""
    tl, rows = _around(df)
    ok = (
        (F.col(classification) == "Likely Sensor/Data Fault")
        & F.col(isolated)
        & F.col("_p_temperature").isNotNull()
        & F.col("_n_temperature").isNotNull()
    )
    out = tl.done(rows).withColumns(
        {
            "estimated_temperature": F.when(ok, (F.col("_p_temperature") + F.col("_n_temperature")) / 2),
            "recovery_method": F.when(ok, NEIGHBOR),
            "recovery_available": F.coalesce(ok, F.lit(False)),
        }
    )
    return out.drop("_pt", "_nt", *[f"_{s}_{c}" for s in "pn" for c in CHANNELS])
