"""Queries: fitted models over the observations (no SQL twin: fits are iterative)."""

import math

from pyspark.sql import functions as F

from fieldwatch.config import CHANNELS, FEATURES, SEQUENCE_ROWS
from fieldwatch.decisions import Settings
from fieldwatch.operators import forest, sequences
from fieldwatch.operators.cleaning import split_by_fraction
from fieldwatch.operators.features import fit_scaler, scale
from fieldwatch.operators.qc import quality_control
from fieldwatch.operators.reconstruction import MODEL_SCHEMA, fit_reconstruction, reconstruction_errors, scaled_windows
from fieldwatch.plans.catalog import Catalog
from fieldwatch.plans.driver_views import dense
from fieldwatch.plans.sqltext import DENSE, sql
from fieldwatch.plans.q_features import split_features
from fieldwatch.session import cut, work_path
from fieldwatch.sources.models import load_model, save_model
from fieldwatch.training import train_forest

cat = Catalog()
KEYS = ["station_id", "timestamp"]
Z = [f"{f}_z" for f in FEATURES]


def prepared(spark, d):
    rows = split_features(spark, d)
    scaler = cut(fit_scaler(rows.where("split = 'train' AND valid_features"), FEATURES), "scaler")
    return scale(rows, scaler, FEATURES).select(*KEYS, "split", *Z), scaler


def fitted(spark, d):
    rows, scaler = prepared(spark, d)
    rows = cut(rows, "scaled")
    nodes = cut(forest.fit_forest(rows.where("split = 'train'"), Z), "nodes")
    return rows, scaler, nodes


@cat.query()
def iforest_fit(spark, d):
    return fitted(spark, d)[2]


def scored(spark, d):
    rows, scaler, nodes = fitted(spark, d)
    raw = cut(forest.score_forest(rows, nodes, Z), "raw")
    train = raw.where("split = 'train'")
    offset = forest.decision_offset(train, 0.05)
    out = forest.decide(raw, offset)
    bounds = forest.score_bounds(out.where("split = 'train'"), "decision_score")
    return forest.normalize_scores(out, bounds, "decision_score", "anomaly_score"), (scaler, nodes, offset, bounds)


@cat.query()
def iforest_score(spark, d):
    out, _ = scored(spark, d)
    return out.select(*KEYS, "split", "decision_score", "prediction", "anomaly_flag", "anomaly_score")


@cat.query()
def reconstruction_errors_query(spark, d):
    """Scaler and components come from clean windows of the training rows; all windows are
    scored.  Without a clean training window there is no model, and the errors are null."""
    checked = quality_control(dense(spark, d).select(*KEYS, *CHANNELS)).select(*KEYS, *CHANNELS, (F.col("qc_flag") != "PASSED").alias("flagged"))
    rows = cut(split_by_fraction(checked), "sequence-rows")
    train = rows.where("split = 'train'")
    scaler = fit_scaler(train.where("NOT flagged"), CHANNELS)
    windows = cut(scaled_windows(sequences.sequence_windows(train, clean_flag="flagged"), scaler), "windows")
    every = scaled_windows(sequences.sequence_windows(rows), scaler)
    if windows.isEmpty():
        return every.select(*KEYS, *[F.lit(None).cast("double").alias(c) for c in ("mse", *[f"{c}_mse" for c in CHANNELS])])
    return reconstruction_errors(every, fit_reconstruction(windows))


cat.queries["reconstruction_errors"] = cat.queries.pop("reconstruction_errors_query")


@cat.query(sql(DENSE, body='SELECT station_id, "timestamp", true AS same FROM dense'))
def model_tables_save_load(spark, d):
    """Save every part, load it again, score again: the scores must agree on every row."""
    path = work_path(spark, "model")
    out, (scaler, nodes, offset, bounds) = scored(spark, d)
    save_model({"scaler": scaler, "nodes": nodes, "offset": offset, "bounds": bounds}, path)
    parts = load_model(spark, path, ("scaler", "nodes", "offset", "bounds"))
    rows, _ = prepared(spark, d)
    again = forest.decide(forest.score_forest(rows, parts["nodes"], Z), parts["offset"])
    again = forest.normalize_scores(again, parts["bounds"], "decision_score", "second")
    both = out.select(*KEYS, "anomaly_score").join(again.select(*KEYS, "second"), KEYS)
    near = F.abs(F.col("anomaly_score") - F.col("second")) < 1e-9
    missing = F.col("anomaly_score").isNull() & F.col("second").isNull()
    return both.select(*KEYS, F.coalesce(near, missing).alias("same"))


# A small forest, written out, so that its paths can be walked in SQL: (tree, node, feature, split, size, leaf).
FIXED_FOREST = (
    (0, 0, 0, -15.0, 256, False),
    (0, 1, 1, 60.0, 100, False),
    (0, 2, -1, 0.0, 156, True),
    (0, 3, -1, 0.0, 1, True),
    (0, 4, -1, 0.0, 99, True),
    (1, 0, 1, 45.0, 256, False),
    (1, 1, -1, 0.0, 6, True),
    (1, 2, -1, 0.0, 250, True),
)


def _mean_path(n):
    return f"(2 * (ln({n} - 1.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2 * ({n} - 1.0::DOUBLE) / {n})"


@cat.query(
    sql(
        DENSE,
        body=f"""SELECT station_id, "timestamp", round(-pow(2, -((a + b) / 2) / {_mean_path(256)}), 9) AS raw_score FROM (
  SELECT *, CASE WHEN temperature <= -15 THEN CASE WHEN humidity <= 60 THEN 2.0::DOUBLE ELSE 2 + {_mean_path(99)} END ELSE 1 + {_mean_path(156)} END AS a,
    CASE WHEN humidity <= 45 THEN 1 + {_mean_path(6)} ELSE 1 + {_mean_path(250)} END AS b FROM dense)""",
    )
)
def iforest_score_fixed(spark, d):
    """Scores of a written-out forest: the path lengths checked without a fit."""
    nodes = spark.createDataFrame(FIXED_FOREST, forest.NODE_SCHEMA)
    out = forest.score_forest(dense(spark, d), nodes, ("temperature", "humidity"))
    return out.select(*KEYS, F.round("raw_score", 9).alias("raw_score"))


#: A scaler and two loadings by rule: all places of a window alike, and temperature against pressure.
FIXED_SCALE = {"temperature": (-15.0, 5.0), "pressure": (960.0, 20.0), "humidity": (50.0, 20.0)}
FIXED_LIMIT, FIXED_OFFSET = 0.8, -0.45


def fixed_windows(spark):
    """(scaler, components) of the written-out window model."""
    scaler = spark.createDataFrame(
        [[x for c in CHANNELS for x in FIXED_SCALE[c]]], ", ".join(f"{c}__mean double, {c}__std double" for c in CHANNELS)
    )
    n = SEQUENCE_ROWS * len(CHANNELS)
    even, against = 1 / math.sqrt(n), 1 / math.sqrt(2 * SEQUENCE_ROWS)
    table = [(-1, [0.0] * n), (0, [even] * n), (1, [against, -against, 0.0] * SEQUENCE_ROWS)]
    return scaler, spark.createDataFrame(table, MODEL_SCHEMA)


def fixed_errors(rows):
    """Window errors of the written-out model, on the last row of each window."""
    scaler, model = fixed_windows(rows.sparkSession)
    return reconstruction_errors(scaled_windows(sequences.sequence_windows(rows.select(*KEYS, *CHANNELS)), scaler), model)


def fixed_errors_sql(name):
    """CTE `errors` over a table: what is left of a window's squared length beside its two projections."""
    z = {c: f"(({c} - {m}::DOUBLE) / {s}::DOUBLE)" for c, (m, s) in FIXED_SCALE.items()}
    over = 'OVER (PARTITION BY station_id ORDER BY "timestamp" ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)'
    return f"""steps_ AS (SELECT station_id, "timestamp", {z["temperature"]} AS a, {z["pressure"]} AS b, {z["humidity"]} AS c,
    CASE WHEN "timestamp" - lag("timestamp") OVER (PARTITION BY station_id ORDER BY "timestamp") > INTERVAL 90 MINUTE THEN 1 ELSE 0 END AS far FROM {name}),
errors AS (SELECT station_id, "timestamp", (squares - sums * sums / 72 - apart * apart / 48) / 72 AS mse FROM (
    SELECT *, count(*) {over} AS n, count(a) {over} + count(b) {over} + count(c) {over} AS there,
      sum(far) OVER (PARTITION BY station_id ORDER BY "timestamp" ROWS BETWEEN 22 PRECEDING AND CURRENT ROW) AS breaks,
      sum(a * a + b * b + c * c) {over} AS squares, sum(a + b + c) {over} AS sums, sum(a - b) {over} AS apart FROM steps_)
  WHERE n = 24 AND there = 72 AND breaks = 0)"""


@cat.query(sql(DENSE, fixed_errors_sql("dense"), body='SELECT station_id, "timestamp", round(mse, 6) AS mse FROM errors'))
def reconstruction_errors_fixed(spark, d):
    """Errors of the written-out window model: the projections checked without a fit."""
    return fixed_errors(dense(spark, d)).select(*KEYS, F.round("mse", 6).alias("mse"))


def fixed_forest_flags(rows):
    """Flags of the written-out forest: a raw score below the fixed offset."""
    nodes = rows.sparkSession.createDataFrame(FIXED_FOREST, forest.NODE_SCHEMA)
    raw = forest.score_forest(rows.select(*KEYS, "temperature", "humidity"), nodes, ("temperature", "humidity"))
    return raw.select(*KEYS, (F.round("raw_score", 9) < FIXED_OFFSET).alias("iforest_flag"))


def fixed_forest_sql(name):
    """CTE `forest_flags` over a table."""
    return f"""forest_flags AS (SELECT station_id, "timestamp", round(-pow(2, -((a + b) / 2) / {_mean_path(256)}), 9) < {FIXED_OFFSET} AS iforest_flag FROM (
  SELECT *, CASE WHEN temperature <= -15 THEN CASE WHEN humidity <= 60 THEN 2.0::DOUBLE ELSE 2 + {_mean_path(99)} END ELSE 1 + {_mean_path(156)} END AS a,
    CASE WHEN humidity <= 45 THEN 1 + {_mean_path(6)} ELSE 1 + {_mean_path(250)} END AS b FROM {name} WHERE temperature IS NOT NULL AND humidity IS NOT NULL))"""


@cat.query(
    sql(
        DENSE,
        body="""SELECT CASE WHEN "timestamp" < TIMESTAMP '2024-01-16' THEN 'train' WHEN "timestamp" < TIMESTAMP '2024-01-24' THEN 'validation' ELSE 'test' END AS split,
  count(*) AS rows, min("timestamp") AS first, max("timestamp") AS last, true AS rate_as_asked, true AS counts_agree FROM dense WHERE "timestamp" >= TIMESTAMP '2024-01-03' GROUP BY 1""",
    )
)
def forest_training(spark, d):
    """The forest fitted by date, with its report: the training period's rate is the contamination
    asked for, and the report's counts are those of the scored rows."""
    done = train_forest(dense(spark, d), "2024-01-03", "2024-01-16", "2024-01-24", Settings(trees=50, contamination=0.03))
    counted = done.scored.groupBy("split").agg(F.count_if("iforest_flag").alias("_n"))
    as_asked = (F.col("split") != "train") | (F.abs(F.col("anomaly_pct") - 3.0) <= 0.5)
    return done.report.join(counted, "split").select("split", "rows", "first", "last", as_asked.alias("rate_as_asked"), (F.col("_n") == F.col("anomalies")).alias("counts_agree"))
