"""The batch job: raw observations to explained decisions and the alert log.

Every step is an operator of its own; this module joins them.  The observation table is
checked and stored once, and all later steps read that stored table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwatch.config import CANONICAL_NAMES, CHANNELS, FEATURES, SEQUENCE_ERROR_THRESHOLD
from fieldwatch.operators import alerts, cleaning, features, forest, fusion, health, multivariate, recovery, sequences, spatial, structure
from fieldwatch.operators.qc import quality_control
from fieldwatch.operators.reconstruction import MODEL_SCHEMA, fit_reconstruction, reconstruction_errors, scaled_windows
from fieldwatch.session import cut, row_sized
from fieldwatch.streaming import state

KEYS = ["station_id", "timestamp"]
SCALED = [f"{f}_z" for f in FEATURES]
QC_COLUMNS = [*KEYS, *CHANNELS, "qc_flag", "qc_reasons", *[f"{c}_{k}" for k in ("spike", "flatline") for c in CHANNELS], "missing_flag", "gap_flag"]


def clean_observations(raw: DataFrame, station: str = "station_id", order: str | None = None) -> DataFrame:
    """Raw rows as observations: columns checked and renamed, sentinels null, times read, one row per time.

    order: column that says which of several rows of one time came first (default: by value).
    Rows without a readable time are left out.
    """
    rows = cleaning.canonicalize_columns(cleaning.validate_columns(raw))
    rows = rows.withColumnRenamed(station, "station_id").withColumnRenamed("relative_humidity", "humidity")
    rows = cleaning.numeric_coerce(rows, CHANNELS)
    rows = cleaning.parse_timestamps(cleaning.sentinels_to_null(rows, CHANNELS))
    rows = rows.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).where(F.col("timestamp").isNotNull())
    if order is None:
        rows = rows.withColumn("_order", F.xxhash64(*[c for c in CANONICAL_NAMES.values() if c in rows.columns]))
    out = structure.dedup_timestamps(rows, order or "_order")
    return out.select(*KEYS, *CHANNELS)


@dataclass(frozen=True)
class Settings:
    """Training choices: share of each station's rows to train on, trees, contamination
    (None: the fixed cut), components of the window model, quantile of its errors."""

    train: float = 0.70
    validation: float = 0.85
    trees: int = 100
    contamination: float | None = 0.03
    components: int = 8
    error_quantile: float = 0.99


#: Tables of the fitted models, by name: none has more rows than a forest has nodes.
MODEL_TABLES = (
    "forest_scaler", "forest_nodes", "forest_offset", "forest_bounds",
    "window_scaler", "window_components", "window_limit",
    "change_scaler", "change_limit",
)


def training_rows(observations: DataFrame, s: Settings) -> DataFrame:
    """Checked observations with features, `split` and `flagged`; stored."""
    qc = cut(quality_control(observations.select(*KEYS, *CHANNELS)), "checked")
    table = cleaning.split_by_fraction(features.feature_table(qc.select(*KEYS, *CHANNELS)), s.train, s.validation)
    return cut(table.join(row_sized(qc.select(*KEYS, (F.col("qc_flag") != "PASSED").alias("flagged"))), KEYS), "features")


def fit_forest_models(rows: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """Forest, offset and score bounds from the training rows with all features."""
    train = rows.where(F.col("split") == "train")
    scaler = cut(features.fit_scaler(train.where("valid_features"), FEATURES), "scaler")
    scaled = cut(features.scale(train, scaler, FEATURES).select(*KEYS, *SCALED), "scaled")
    nodes = cut(forest.fit_forest(scaled, SCALED, s.trees), "nodes")
    raw = cut(forest.score_forest(scaled, nodes, SCALED).select(*KEYS, "raw_score"), "raw")
    offset = cut(forest.decision_offset(raw, s.contamination), "offset")
    bounds = forest.score_bounds(forest.decide(raw, offset), "decision_score")
    return {"forest_scaler": scaler, "forest_nodes": nodes, "forest_offset": offset, "forest_bounds": bounds}


def _fit_windows(rows: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """Scaler and components from clean training windows only, the limit a quantile of their
    errors.  Without any such window the components are an empty table."""
    train = F.col("split") == "train"
    scaler = cut(features.fit_scaler(rows.where(train & ~F.col("flagged")), CHANNELS), "scaler")
    windows = sequences.sequence_windows(rows.where(train), clean_flag="flagged")
    windows = cut(scaled_windows(windows, scaler), "train-windows")
    if windows.isEmpty():
        spark = rows.sparkSession
        model, limit = spark.createDataFrame([], MODEL_SCHEMA), spark.createDataFrame([], "threshold double")
    else:
        model = cut(fit_reconstruction(windows, s.components), "components")
        limit = sequences.error_threshold(reconstruction_errors(windows, model), "mse", s.error_quantile)
    return {"window_scaler": scaler, "window_components": model, "window_limit": limit}


def fit_models(observations: DataFrame, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """Forest, window and change models of the observations: small tables, for
    sources.models.save_model and load_model."""
    return fit_on(training_rows(observations, settings), settings)


def fit_on(rows: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """The models, from rows as `training_rows` gives them."""
    clean_train = rows.where((F.col("split") == "train") & ~F.col("flagged"))
    scaler, limit = multivariate.fit_changes(clean_train)
    return {**fit_forest_models(rows, settings), **_fit_windows(rows, settings), "change_scaler": scaler, "change_limit": limit}


def forest_scores(rows: DataFrame, models: dict[str, DataFrame], keep: tuple[str, ...] | None = None) -> DataFrame:
    """iforest_score and iforest_flag per row; with other columns to keep, also decision_score."""
    held = keep or ()
    scaled = features.scale(rows, models["forest_scaler"], FEATURES).select(*KEYS, *held, *SCALED)
    raw = forest.score_forest(scaled, models["forest_nodes"], SCALED).select(*KEYS, *held, "raw_score")
    out = forest.normalize_scores(forest.decide(raw, models["forest_offset"]), models["forest_bounds"], "decision_score", "iforest_score")
    flag = F.when(F.col("decision_score").isNotNull(), F.col("anomaly_flag")).alias("iforest_flag")
    return out.select(*KEYS, *held, "iforest_score", flag, *([] if keep is None else ["decision_score"]))


def sequence_errors(windows: DataFrame, models: dict[str, DataFrame]) -> DataFrame:
    """sequence_mse and sequence_flag on the last row of each window.

    Errors are scaled so that the fitted limit lands on the fixed threshold, which the
    evidence rules refer to.  They are compared to nine places: the last bits of a matrix
    product depend on how many windows are scored at once.
    """
    if models["window_components"].isEmpty():
        return windows.select(*KEYS, F.lit(None).cast("double").alias("sequence_mse"), F.lit(None).cast("boolean").alias("sequence_flag"))
    errors = reconstruction_errors(scaled_windows(windows, models["window_scaler"]), models["window_components"])
    scaled = errors.crossJoin(F.broadcast(models["window_limit"]))  # one row
    mse = F.col("mse") * SEQUENCE_ERROR_THRESHOLD / F.greatest("threshold", F.lit(1e-12))
    return scaled.select(*KEYS, mse.alias("sequence_mse"), (F.round("mse", 9) > F.round("threshold", 9)).alias("sequence_flag"))


RECOVERED = ["observed_value", "estimated_value", "unit", "recovery_status", "recovery_method"]


def _asked(rows: DataFrame) -> DataFrame:
    """Which rows and parameters to estimate: the primary parameter of rows that are not normal."""
    one = F.array_compact(F.array(F.when(F.col("primary_parameter").isin(*CHANNELS), F.col("primary_parameter"))))
    return rows.withColumns({"_flagged": F.col("classification") != fusion.NORMAL, "_wanted": one})


def _recovered(estimates: DataFrame) -> DataFrame:
    return estimates.select(
        *KEYS, *RECOVERED, F.col("previous_timestamp").alias("previous_observation_timestamp"), F.col("next_timestamp").alias("next_observation_timestamp")
    )


def signals(qc: DataFrame, scored: list[DataFrame], near: DataFrame, state: DataFrame) -> DataFrame:
    """Checked rows with the scores of all models, the neighbours' verdict and the station's health."""
    out = qc
    for scores in scored:
        out = out.join(row_sized(scores), KEYS, "left")
    near = near.select(*KEYS, "spatial_status", "spatial_score", "spatial_agreement", "buddy_station_id")
    state = state.select(*KEYS, "overall_health_index", "overall_status", "active_alerts")
    return out.join(row_sized(near), KEYS, "left").join(row_sized(state), KEYS, "left")


def _decided(fused: DataFrame, estimates: DataFrame) -> DataFrame:
    held = fused.select(*KEYS, "overall_health_index", "overall_status")
    return fusion.decision_row(fused).join(row_sized(held), KEYS).join(row_sized(_recovered(estimates)), KEYS, "left")


def run_decisions(
    observations: DataFrame, readings: DataFrame, distances: DataFrame, settings: Settings = Settings(), models: dict[str, DataFrame] | None = None
) -> DataFrame:
    """One decision per observation, with the results it rests on.

    observations: station_id, timestamp (no repeats), temperature, pressure, humidity.
    readings and distances: the neighbours' values and pairs, as spatial.buddy_join takes
    them.  models: tables of `fit_models`; fitted on these observations if not given.
    Columns: those of fusion.decision_row, the health of the station at that time, and the
    observed and recovered value.  The stored intermediate tables lie in the shared
    working folder.
    """
    qc = cut(quality_control(observations.select(*KEYS, *CHANNELS)), "checked")
    table = features.feature_table(qc.select(*KEYS, *CHANNELS))
    if models is None:
        table = cleaning.split_by_fraction(table, settings.train, settings.validation)
        table = cut(table.join(row_sized(qc.select(*KEYS, (F.col("qc_flag") != "PASSED").alias("flagged"))), KEYS), "features")
        models = fit_on(table, settings)
    else:
        table = cut(table, "features")
    scored = [
        forest_scores(table, models),
        sequence_errors(sequences.sequence_windows(qc.select(*KEYS, *CHANNELS)), models),
        multivariate.score_changes(table, models["change_scaler"], models["change_limit"]).select(*KEYS, "multivariate_score", "multivariate_anomaly"),
    ]
    near = spatial.spatial_check(spatial.buddy_join(qc.select(*KEYS, *CHANNELS), readings, distances))
    fused = cut(fusion.fuse(signals(qc, scored, near, health.station_health(health.parameter_health(qc)))), "fused")
    asked = _asked(fused).select(*KEYS, *CHANNELS, "_flagged", "_wanted")
    return _decided(fused, recovery.recover_neighbors(asked, "_flagged", "_wanted"))


def decide_arrivals(rows: DataFrame, readings: DataFrame, distances: DataFrame, models: dict[str, DataFrame]) -> DataFrame:
    """Decisions of one micro-batch of `streaming.decisions.checked_stream`, as run_decisions gives them, and `final`."""
    features_of = state.context_features(rows)
    scored = [
        forest_scores(features_of, models),
        sequence_errors(state.context_windows(rows), models),
        multivariate.score_changes(features_of, models["change_scaler"], models["change_limit"]).select(*KEYS, "multivariate_score", "multivariate_anomaly"),
    ]
    near = spatial.spatial_check(spatial.buddy_join(rows.select(*KEYS, *CHANNELS), readings, distances))
    around = [F.col("p_timestamp").alias("_pt"), F.col("n_timestamp").alias("_nt")]
    around += [F.col(f"{p}_{c}").alias(f"_{p}_{c}") for c in CHANNELS for p in "pn"]
    qc = rows.select(*QC_COLUMNS, "final", *around)
    fused = cut(fusion.fuse(signals(qc, scored, near, health.station_health(state.channel_health(rows)))), "fused")
    estimates = recovery.neighbor_estimates(_asked(fused), "_flagged", "_wanted")
    return _decided(fused, estimates).join(row_sized(fused.select(*KEYS, "final")), KEYS)


def log_rows(decisions: DataFrame, created_at) -> DataFrame:
    """Decisions as rows of the alert log, with their keys.  Ids follow from the key's parts, so a rerun gives the same ones."""
    rows = decisions.select(
        F.xxhash64("station_id", F.col("timestamp").cast("string")).alias("id"),
        "timestamp",
        "station_id",
        "classification",
        "severity",
        "observed_value",
        "estimated_value",
        "recovery_status",
        "recovery_method",
        "previous_observation_timestamp",
        "next_observation_timestamp",
        F.col("overall_health_index").alias("health_index"),
        F.lit(None).cast("string").alias("alert_key"),
        F.col("primary_parameter").alias("parameter"),
        F.col("probable_cause").alias("anomaly_type"),
        "payload_json",
        F.lit(created_at).alias("created_at"),
    )
    return alerts.with_alert_keys(rows)


def update_log(spark: SparkSession, decisions: DataFrame, path: str, created_at, token: str | None = None) -> None:
    """Upsert all decisions that are not normal into the log at `path`; token: as in alerts.upsert_table."""
    found = decisions.where(F.col("classification") != fusion.NORMAL)
    alerts.upsert_table(spark, path, log_rows(found, created_at), token)
