"""Joins that stay balanced when one key holds a large share of the rows.

A shuffle join sends every row of a key to one task. ``split_hot_join`` first finds the
keys of the large side with too many rows (from a sample, see ``hot_keys``), then joins
the hot keys (about ``hot_rows`` rows or more each) against a broadcast copy of their
matching rows on the other side, and only the remaining keys through the shuffle. Only a
few keys can be that large (about 2 x rows / hot_rows at most), and the other side is
unique per key; the broadcast side is still counted before it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sizing import broadcast_if_small, pin

HOT_KEY_ROWS_KEY = "spark.basketgraph.hotKeyRows"
DEFAULT_HOT_KEY_ROWS = 1_000_000


def hot_key_rows(spark) -> int:
    return int(spark.conf.get(HOT_KEY_ROWS_KEY, str(DEFAULT_HOT_KEY_ROWS)))


# A key at the threshold is expected this many times in the sample.
SAMPLE_HITS = 1000


def hot_keys(big: DataFrame, key: str, hot_rows: int) -> tuple[DataFrame, int]:
    """Keys of ``big`` with more than about ``hot_rows`` rows, written and counted.

    Counting every key exactly would shuffle one row per distinct key, nearly as much as
    the join itself. Instead a Bernoulli sample of rate SAMPLE_HITS / hot_rows is counted:
    a key at the threshold appears about SAMPLE_HITS times, and keys seen more than half
    that often are hot. A key put on the wrong side only changes which branch joins it,
    never the result. Thresholds under SAMPLE_HITS count exactly.
    """
    fraction = min(1.0, SAMPLE_HITS / max(hot_rows, 1))
    if fraction >= 1.0:
        sample, cut = big, hot_rows
    else:
        sample, cut = big.sample(fraction=fraction, seed=17), SAMPLE_HITS // 2
    return pin(sample.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
                     .where(F.col("_n") > cut).select(key), "hot-keys")


def split_hot_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner",
                   hot_rows: int | None = None) -> DataFrame:
    """``big.join(small, key, how)`` for ``how`` in inner / left_semi / left_anti, where
    ``small`` has at most one row per key."""
    if how not in ("inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    if hot_rows is None:
        hot_rows = hot_key_rows(big.sparkSession)
    hot, n_hot = hot_keys(big, key, hot_rows)
    if n_hot == 0:
        return big.join(small, key, how)
    hot_side = broadcast_if_small(hot, n_hot)
    small_hot, n_small_hot = pin(small.join(hot_side, key, "left_semi"), "hot-rows")
    hot_part = (big.join(hot_side, key, "left_semi")
                   .join(broadcast_if_small(small_hot, n_small_hot), key, how))
    cold_part = big.join(hot_side, key, "left_anti").join(small, key, how)
    return hot_part.unionByName(cold_part)
