"""Parquet tables of one data directory, read through Spark so that any file system it knows works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazily opens ``<sf_dir>/<name>.parquet`` (a file or a directory of part files)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
