"""Reading the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def reader(spark: SparkSession, folder: str) -> Callable[[str], DataFrame]:
    """``table(name)`` reads ``<folder>/<name>.parquet``."""
    return lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
