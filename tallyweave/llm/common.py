"""What several operators share: reading tables, cutting lineage, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyweave.graph import connected_components
from tallyweave.scratch import Tables, delete, discard, shared_dir, written

__all__ = ["Tables", "connected_components", "delete", "discard", "shared_dir", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
