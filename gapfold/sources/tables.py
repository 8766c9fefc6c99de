"""Named tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table `name`; columns and filters prune at the scan."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
