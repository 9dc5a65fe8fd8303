"""A10 full-refresh snapshots and A11 result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Full refresh: whatever was at ``path`` is replaced by ``df`` (Parquet)."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    """Results as headered CSV, one directory per run (each task writes its own part)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str, schema) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
            .csv(path))
