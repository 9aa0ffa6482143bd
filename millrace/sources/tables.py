"""Loading the named Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; its schema is that of the Parquet files."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
