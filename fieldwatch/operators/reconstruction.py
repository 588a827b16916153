"""Reconstruction error of sequence windows by principal components.

A linear reconstruction stands where a neural autoencoder would: the fit is one distributed
covariance over the windows, the model is a small table, and scoring is a matrix product.
Everything after it only needs the error column.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwatch.config import CHANNELS

ERROR_SCHEMA = "mse double, temperature_mse double, pressure_mse double, humidity_mse double"
MODEL_SCHEMA = "component int, loading array<double>"


def scaled_windows(windows: DataFrame, scaler: DataFrame) -> DataFrame:
    """Windows as flat arrays, row by row, each channel scaled by the fitted scaler."""

    def row(x):
        return F.array(
            *[
                (x[c] - F.col(f"{c}__mean"))
                / F.when(F.col(f"{c}__std") == 0, 1.0).otherwise(F.col(f"{c}__std"))
                for c in CHANNELS
            ]
        )

    return windows.crossJoin(F.broadcast(scaler)).select(  # one row
        "station_id", "timestamp", F.flatten(F.transform("window", row)).alias("x")
    )


def fit_reconstruction(train: DataFrame, components: int = 8) -> DataFrame:
    """The model as a table: component -1 is the mean window, the others are loadings.  Its
    size depends on the window length only."""
    spark = train.sparkSession
    rows = train.select(array_to_vector("x").alias("v"))
    mean = rows.agg(Summarizer.mean(F.col("v")).alias("m")).first()["m"].toArray()
    loadings = PCA(k=components, inputCol="v", outputCol="y").fit(rows).pc.toArray().T
    table = [(-1, mean.tolist()), *[(i, r.tolist()) for i, r in enumerate(loadings)]]
    return spark.createDataFrame(table, MODEL_SCHEMA)


def reconstruction_errors(windows: DataFrame, model: DataFrame) -> DataFrame:
    """Adds the mean squared error of each window, overall and per channel."""
    table = sorted(model.collect(), key=lambda r: r["component"])
    mean = np.asarray(table[0]["loading"])
    basis = np.asarray([r["loading"] for r in table[1:]])

    @F.pandas_udf(ERROR_SCHEMA)
    def errors(x: pd.Series) -> pd.DataFrame:
        if len(x) == 0:
            return pd.DataFrame(columns=["mse", *[f"{c}_mse" for c in CHANNELS]], dtype=float)
        centred = np.stack(x.to_numpy()) - mean
        square = (centred - centred @ basis.T @ basis) ** 2
        per_channel = square.reshape(len(x), -1, len(CHANNELS)).mean(axis=1)
        out = {"mse": square.mean(axis=1)}
        out.update({f"{c}_mse": per_channel[:, i] for i, c in enumerate(CHANNELS)})
        return pd.DataFrame(out)

    return windows.withColumn("_e", errors("x")).select("station_id", "timestamp", "_e.*")
