"""Where intermediate tables go, and the tables of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import discard, new_path, persist, shared_dir

__all__ = ["discard", "new_path", "persist", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
