"""Training the forest by date: fit on one period, judge the later ones, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwatch import decisions
from fieldwatch.config import CHANNELS
from fieldwatch.operators import cleaning, features
from fieldwatch.session import cut

KEYS = ["station_id", "timestamp"]


@dataclass(frozen=True)
class Training:
    """models: tables for sources.models.save_model; report: one row per split; scored: every
    row of the periods with its flag and scores."""

    models: dict[str, DataFrame]
    report: DataFrame
    scored: DataFrame

    def audit(self, at: Column) -> DataFrame:
        """The scored rows of a known case."""
        return self.scored.where(at).select(
            *KEYS, *CHANNELS, "iforest_flag", F.round("iforest_score", 4).alias("iforest_score"), F.round("decision_score", 4).alias("decision_score")
        )


def train_forest(
    observations: DataFrame, start, train_end, validation_end, settings: decisions.Settings = decisions.Settings()
) -> Training:
    """Fit the forest on the rows from `start` up to before `train_end`, and score those of all periods.

    The share `contamination` of the training rows is flagged by construction; the rates of
    the later periods tell how well that carries over.  Rows with a missing feature are
    counted and not flagged.  Rows before `start` only give the first rows their context.
    """
    rows = features.feature_table(observations.select(*KEYS, *CHANNELS)).where(F.col("timestamp") >= start)
    rows = cut(cleaning.split_by_date(rows, train_end, validation_end), "training-rows")
    models = decisions.fit_forest_models(rows, settings)
    scored = cut(decisions.forest_scores(rows, models, keep=("split", *CHANNELS)), "scored")
    flagged = scored.withColumn("_flag", F.coalesce("iforest_flag", F.lit(False)))
    period = scored.groupBy("split").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count("decision_score").alias("scored_rows"))
    return Training(models, features.anomaly_rates_by_split(flagged, "_flag").join(period, "split"), scored)
