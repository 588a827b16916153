"""Fitted models as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def save_model(parts: dict[str, DataFrame], path: str) -> None:
    """parts: name -> table (forest nodes, scaler, offset, score bounds, reconstruction, ...)."""
    for name, table in parts.items():
        table.write.parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, names) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
