"""The live job: arriving observations to decisions and the alert log.

Two chained stateful operators add what a row's decision needs of its station: the rows
around it (streaming.state.Context) and the running health of its channels
(StationHealth).  Between them and after them the batch job's column expressions run.
Each micro-batch is then scored with stored models, compared with its neighbours, fused,
written and merged into the log.

A row is decided as soon as it arrives and again while later rows can still change its
decision: a flatline is known from its fourth row on, an estimate needs the next row.  The
last decision of a row, its final one, equals the batch job's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldwatch import decisions
from fieldwatch.config import CHANNELS, SERVICE, Profile
from fieldwatch.operators.qc import qc_result
from fieldwatch.session import cut
from fieldwatch.streaming import state
from fieldwatch.timeline import hours_between

KEYS = ["station_id", "timestamp"]


def checked_stream(rows: DataFrame, profile: Profile = SERVICE) -> DataFrame:
    """Arriving observations with their QC result, the rows around them and their channels' running health."""
    context = state.stream_context(rows, profile)
    context = context.withColumns({"_h": hours_between(F.col("p_timestamp"), F.col("timestamp")), **{f"_p_{c}": F.col(f"p_{c}") for c in CHANNELS}})
    keep = [c for c in context.columns if c not in (*KEYS, *CHANNELS) and not c.startswith("_") and not c.endswith("_flatline")]
    return state.stream_station_health(qc_result(context, profile, keep=tuple(keep)))


def write_batch(batch: DataFrame, number: int, path: str, readings: DataFrame, distances: DataFrame, models: dict, log: str | None, created_at) -> None:
    """Decide one micro-batch.  Its rows go to a folder of its own, so a repeated batch replaces what it wrote."""
    rows = cut(batch, "arrived")
    if rows.isEmpty():
        return
    decided = decisions.decide_arrivals(rows, readings, distances, models)
    out = f"{path}/batch={number}"
    decided.write.mode("overwrite").parquet(out)
    if log:
        decisions.update_log(batch.sparkSession, batch.sparkSession.read.schema(decided.schema).parquet(out), log, created_at, f"{path}#{number}")


def decision_stream(
    rows: DataFrame,
    readings: DataFrame,
    distances: DataFrame,
    models: dict[str, DataFrame],
    path: str,
    checkpoint: str,
    log: str | None = None,
    created_at=None,
    profile: Profile = SERVICE,
) -> StreamingQuery:
    """Start the job over what there is of `rows` (station_id, timestamp, channels).

    models: stored tables of decisions.fit_models.  Decisions go to `path` (see
    current_decisions), those that are not normal also to the log at `log`.
    """

    def write(batch: DataFrame, number: int) -> None:
        write_batch(batch, number, path, readings, distances, models, log, created_at)

    return (
        checked_stream(rows, profile)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def current_decisions(spark: SparkSession, path: str) -> DataFrame:
    """The last decision of each observation."""
    rows = spark.read.parquet(path)
    last = F.max_by(F.struct(*rows.columns), F.col("batch"))
    return rows.groupBy(*KEYS).agg(last.alias("_r")).select("_r.*").drop("batch")
