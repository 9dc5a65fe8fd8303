"""Run logs: (engine, query, iteration, elapsed_ms, failed)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUNLOG_SCHEMA = "engine string, query string, iteration long, elapsed_ms double, failed boolean"


def runs_from_events(events: DataFrame, n_queries: int = 8, failed_below: float = 0.1) -> DataFrame:
    """Read an event table as a run log: the event type is the engine, the user id modulo
    ``n_queries`` names the query, the event id orders the runs, the value is the time in
    ms, and a value under ``failed_below`` marks a failed run."""
    return events.select(
        F.col("event_type").alias("engine"),
        F.concat(F.lit("Q"), F.pmod(F.col("user_id"), F.lit(n_queries)).cast("string")).alias("query"),
        F.col("event_id").cast("long").alias("iteration"),
        F.col("value").cast("double").alias("elapsed_ms"),
        (F.col("value") < F.lit(failed_below)).alias("failed"))


def read_runlog_csv(spark, path: str) -> DataFrame:
    return spark.read.schema(RUNLOG_SCHEMA).option("header", True).option("mode", "FAILFAST").csv(path)
