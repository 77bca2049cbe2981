"""Scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One Parquet table of a data directory (a file or a folder of part files)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
