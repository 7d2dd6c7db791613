"""The report tables as Parquet, one folder or file per table."""

from __future__ import annotations

from pyspark.sql import SparkSession

from boletim.schema import LazyTables


def read_parquet(spark: SparkSession, path: str, suffix: str = "") -> LazyTables:
    """Read ``path/<table><suffix>`` for each report table that is asked for."""
    root = path.rstrip("/")
    return LazyTables(lambda name: spark.read.parquet(f"{root}/{name}{suffix}"))
