"""Readers for the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table by name; columns and filters of the caller reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
