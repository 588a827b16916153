"""Controlled evaluation, validation summaries and the joins they use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwatch.config import CHANNELS
from fieldwatch.session import row_sized
from fieldwatch.timeline import Timeline

KEYS = ["station_id", "timestamp"]


def inject_anomalies(df: DataFrame, cases: DataFrame) -> DataFrame:
    """Override readings by labelled cases.

    cases: (station_id, start, stop, channel, value, anomaly_type), hourly and inclusive; each
    is spread over its hours, so this is an equi-join.  Adds `ground_truth`, `anomaly_type`.
    """
    hours = F.explode(F.sequence("start", "stop", F.expr("interval 1 hour")))
    per_row = (
        cases.select("station_id", hours.alias("timestamp"), "channel", "value", "anomaly_type")
        .groupBy(*KEYS)
        .agg(
            *[F.max(F.when(F.col("channel") == c, F.col("value"))).alias(f"_v_{c}") for c in CHANNELS],
            F.max("anomaly_type").alias("_type"),
        )
    )
    out = df.join(row_sized(per_row), KEYS, "left").withColumns(
        {c: F.coalesce(f"_v_{c}", c) for c in CHANNELS}
        | {
            "anomaly_type": F.coalesce("_type", F.lit("Normal")),
            "ground_truth": F.col("_type").isNotNull(),
        }
    )
    return out.drop("_type", *[f"_v_{c}" for c in CHANNELS])


def _metrics(flag: Column, truth: Column) -> list[Column]:
    hit, said, real = F.count_if(flag & truth), F.count_if(flag), F.count_if(truth)

    def pct(a, b):
        return F.round(100.0 * F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 2)

    return [
        pct(hit, said).alias("precision_pct"),
        pct(hit, real).alias("recall_pct"),
        pct(2 * hit, said + real).alias("f1_pct"),
        said.alias("detected"),
    ]


def detection_metrics(df: DataFrame, flag: str, truth: str = "ground_truth") -> DataFrame:
    """Precision, recall, F1 (0 where undefined) and the number detected: one row."""
    return df.agg(*_metrics(F.col(flag), F.col(truth)))


def method_comparison(df: DataFrame, methods: dict[str, str], truth: str = "ground_truth") -> DataFrame:
    """The metrics of several flag columns, in one pass over the rows."""
    renamed = df.select(F.col(truth).alias("_truth"), *[F.col(c).alias(m) for m, c in methods.items()])
    long = renamed.unpivot("_truth", list(methods), "method", "_flag")
    return long.groupBy("method").agg(*_metrics(F.col("_flag"), F.col("_truth")))


def model_evidence(df: DataFrame, forest_scores: DataFrame, window_errors: DataFrame) -> DataFrame:
    """Rows with the votes' model flags: `if_anomaly`, `sequence_anomaly`; false without a score."""
    scored = df.join(row_sized(forest_scores.select(*KEYS, F.col("iforest_flag").alias("_if"))), KEYS, "left")
    scored = scored.join(row_sized(window_errors.select(*KEYS, F.col("sequence_flag").alias("_seq"))), KEYS, "left")
    flags = {"if_anomaly": F.coalesce("_if", F.lit(False)), "sequence_anomaly": F.coalesce("_seq", F.lit(False))}
    return scored.withColumns(flags).drop("_if", "_seq")


def detection_by_type(df: DataFrame) -> DataFrame:
    flags = {"qc": "qc_evidence", "if": "if_evidence", "sequence": "sequence_evidence", "fusion": "final_anomaly"}
    return (
        df.where("ground_truth")
        .groupBy("anomaly_type")
        .agg(
            F.count(F.lit(1)).alias("total"),
            *[F.count_if(F.col(c)).alias(f"{k}_detected") for k, c in flags.items()],
        )
    )


def validation_summary(df: DataFrame) -> DataFrame:
    kind = F.col("final_classification")
    fault = F.count_if(kind == "Likely Sensor/Data Fault")
    return df.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("qc_flag")).alias("qc_anomalies"),
        F.count_if(F.col("if_anomaly")).alias("if_anomalies"),
        F.count_if(F.col("sequence_anomaly")).alias("sequence_anomalies"),
        F.count_if(kind == "Normal").alias("normal"),
        F.count_if(kind == "Uncertain").alias("uncertain"),
        fault.alias("likely_fault"),
        F.round(fault / F.count(F.lit(1)) * 100.0, 2).alias("fault_rate_pct"),
    )


def evidence_histogram(df: DataFrame) -> DataFrame:
    """Rows per evidence count and their share of the dataset."""
    counts = df.groupBy("dataset", "evidence_count").agg(F.count(F.lit(1)).alias("rows"))
    totals = counts.groupBy("dataset").agg(F.sum("rows").alias("_all"))
    return counts.join(totals, "dataset").withColumn(
        "share_pct", F.round(F.col("rows") / F.col("_all") * 100.0, 2)
    ).drop("_all")


def classification_distribution(df: DataFrame, column: str = "final_classification") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def fault_cases(df: DataFrame, n: int = 10) -> DataFrame:
    """The first n strongly supported faults."""
    strong = (F.col("final_classification") == "Likely Sensor/Data Fault") & (F.col("evidence_count") >= 3)
    return df.where(strong).orderBy("timestamp", "station_id").limit(n)


def left_join_evidence(df: DataFrame, evidence: DataFrame) -> DataFrame:
    return df.join(row_sized(evidence), KEYS, "left")


def lookup_flags(df: DataFrame, known: DataFrame, defaults: dict) -> DataFrame:
    """Values looked up by station and time, with a default where there is none."""
    return df.join(row_sized(known), KEYS, "left").fillna(defaults)


def history_tail(df: DataFrame, rows: int, columns: list[str]) -> DataFrame:
    """`history`: the last `rows` rows strictly before each row, oldest first."""
    tl = Timeline(df, lookback=rows)
    tail = F.collect_list(F.struct("timestamp", *columns)).over(tl.w.rowsBetween(-rows, -1))
    return tl.done(tl.df.withColumn("history", tail))


def union_datasets(parts: dict[str, DataFrame]) -> DataFrame:
    """Several tables under one another, each tagged with its name."""
    tagged = [df.withColumn("dataset", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)
