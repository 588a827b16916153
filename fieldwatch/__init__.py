"""Sensor-series quality control and anomaly evidence on Spark DataFrames."""
