"""Summaries of a run log (engine, query, iteration, elapsed_ms, failed)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUP = ["engine", "query"]


def warmup_rows(runs: DataFrame, n: int = 5) -> DataFrame:
    """How many runs of an iteration belong to the first ``n`` runs of their (engine, query):
    (engine, query, iteration, _warm_runs).

    Runs are counted per iteration, so repeated iterations (two logs appended) do not put
    more than ``n`` runs into the warm-up. The running count is limited to the first n
    iterations, of which a partial group limit sends at most n rows per map task.
    """
    per = runs.groupBy(*GROUP, "iteration").agg(F.count(F.lit(1)).alias("_runs"))
    w = Window.partitionBy(*GROUP).orderBy("iteration")
    first = per.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    before = F.sum("_runs").over(w) - F.col("_runs")
    return (first.withColumn("_before", before).where(F.col("_before") < n)
            .select(*GROUP, "iteration", F.least("_runs", n - F.col("_before")).alias("_warm_runs")))


def flag_warmup(runs: DataFrame, n: int) -> DataFrame:
    """``runs`` with ``_warm``: true for the first ``n`` runs of each (engine, query). Of an
    iteration that is only partly warm-up, the runs with the smallest times are taken."""
    marked = runs.join(warmup_rows(runs, n), GROUP + ["iteration"], "left")
    w = Window.partitionBy(*GROUP, "iteration").orderBy("elapsed_ms", "failed")
    early = marked.where(F.col("_warm_runs").isNotNull()).withColumn("_warm", F.row_number().over(w) <= F.col("_warm_runs"))
    rest = marked.where(F.col("_warm_runs").isNull()).withColumn("_warm", F.lit(False))
    return early.unionByName(rest).drop("_warm_runs")


def drop_warmup(runs: DataFrame, n: int = 5) -> DataFrame:
    """Every run except the first ``n`` of its (engine, query)."""
    if n <= 0:
        return runs
    return flag_warmup(runs, n).where(~F.col("_warm")).drop("_warm").select(*runs.columns)


def run_summary(runs: DataFrame, warmup: int = 5) -> DataFrame:
    """(engine, query, runs, mean_ms, std_ms, failed).

    Mean and population standard deviation over the runs after the warm-up. One failed
    run anywhere, warm-up included, empties mean and std for the whole query; so does
    having no run after the warm-up. One aggregation over all runs, map-side combined.
    """
    flagged = runs
    if warmup > 0:
        flagged = flag_warmup(runs, warmup)
    timed = F.coalesce(F.col("_warm"), F.lit(False)) if warmup > 0 else F.lit(False)
    ms = F.when(~timed, F.col("elapsed_ms"))
    agg = (flagged.groupBy(*GROUP)
           .agg(F.count(ms).alias("runs"),
                F.avg(ms).alias("_mean"),
                F.stddev_pop(ms).alias("_std"),
                F.max(F.col("failed").cast("int")).alias("_failed")))
    bad = (F.col("_failed") == 1) | (F.col("runs") == 0)
    return agg.select(*GROUP, F.col("runs").cast("long").alias("runs"),
                      F.when(bad, None).otherwise(F.round("_mean", 6)).alias("mean_ms"),
                      F.when(bad, None).otherwise(F.round("_std", 6)).alias("std_ms"),
                      (F.col("_failed") == 1).alias("failed"))


def compare_runs(summary: DataFrame, engines: list[str]) -> DataFrame:
    """One row per query, the mean of each listed engine side by side, and the ratio
    of every later engine's mean to the first one's: (query, <e>_mean_ms..., <e>_vs_<e0>)."""
    wide = (summary.where(F.col("engine").isin(engines))
            .groupBy("query").pivot("engine", engines).agg(F.first("mean_ms")))
    cols = [F.col("query")]
    for e in engines:
        cols.append(F.col(f"`{e}`").alias(f"{e}_mean_ms"))
    base = engines[0]
    for e in engines[1:]:
        cols.append(F.round(F.col(f"`{e}`") / F.col(f"`{base}`"), 6).alias(f"{e}_vs_{base}"))
    return wide.select(*cols)
