"""Reading the parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``{sf_dir}/{name}.parquet``, a file or a folder of files."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
