"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelake.session import staged

__all__ = ["staged", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
