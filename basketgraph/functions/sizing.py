"""Materialise intermediate tables and broadcast only sides whose size was measured."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import scratch_path

MAX_BROADCAST_ROWS_KEY = "spark.basketgraph.maxBroadcastRows"
DEFAULT_MAX_BROADCAST_ROWS = 2_000_000


def max_broadcast_rows(spark) -> int:
    return int(spark.conf.get(MAX_BROADCAST_ROWS_KEY, str(DEFAULT_MAX_BROADCAST_ROWS)))


def pin(df: DataFrame, label: str = "state", **metrics: Column) -> tuple[DataFrame, int]:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    The returned frame has no lineage behind it (a lost executor costs a re-read, not a
    re-computation of the loop so far) and its row count is known exactly: it is observed
    while writing, in the same job. Extra aggregate ``metrics`` are observed alongside
    and returned through ``pin_metrics``.
    """
    back, seen = pin_metrics(df, label, **metrics)
    return back, seen["rows"]


def pin_metrics(df: DataFrame, label: str = "state", **metrics: Column) -> tuple[DataFrame, dict]:
    spark = df.sparkSession
    path = scratch_path(spark, label)
    obs = Observation(f"{label}-{uuid.uuid4().hex[:8]}")
    aggs = [F.count(F.lit(1)).alias("rows")] + [c.alias(k) for k, c in metrics.items()]
    df.observe(obs, *aggs).write.parquet(path)
    seen = dict(obs.get)
    return spark.read.parquet(path), seen


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint only when the measured row count is under the limit; above it the
    join stays a shuffle join (and AQE may still split skewed partitions)."""
    if rows <= max_broadcast_rows(df.sparkSession):
        return F.broadcast(df)
    return df


_MEASURED: list[DataFrame] = []


def bounded(df: DataFrame, bound: int | None) -> DataFrame:
    """Broadcast ``df`` when a proven row bound is under the limit; otherwise count it
    (``measured``) and decide from the count."""
    if bound is not None and bound <= max_broadcast_rows(df.sparkSession):
        return F.broadcast(df)
    return measured(df)


def measured(df: DataFrame) -> DataFrame:
    """Cache a small, reused frame (a seed set, a seed's neighbourhood), count it, and
    broadcast it if the count allows. The cache is a short lineage (a filter or join of a
    kept table), so a lost block is recomputed; ``release_measured`` frees them all."""
    df = df.cache()
    _MEASURED.append(df)
    return broadcast_if_small(df, df.count())


def release_measured() -> None:
    """Unpersist every frame cached by ``measured`` (call once results are consumed)."""
    while _MEASURED:
        _MEASURED.pop().unpersist()
