"""Parquet tables below one folder, as DataFrames or temporary views."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: The driver's tables.
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of `folder`; a file and a folder of part files read alike."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def create_views(spark: SparkSession, folder: str, names: Iterable[str] = TABLES) -> None:
    """Temporary views over the tables, for SQL text."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
