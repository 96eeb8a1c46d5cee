"""Reading named tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a folder; columns and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
