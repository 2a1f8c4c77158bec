"""The shared folder's workspace, and the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.workspace import Workspace, delete, exists, shared_root

__all__ = ["Workspace", "delete", "exists", "shared_root", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
