"""Key lookups: a few measured keys become a filter that reaches the scan of a sorted table.

A table written by ``write_sorted`` has files of disjoint key ranges, sorted within, so the
filter leaves out all row groups and pages but those that hold a key, and a lookup reads about
the same bytes however large the table is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOOKUP_KEYS_KEY = "spark.basketgraph.lookupKeys"
DEFAULT_LOOKUP_KEYS = 256
ROWS_PER_FILE = 1_000_000


def lookup_keys(spark) -> int:
    return int(spark.conf.get(LOOKUP_KEYS_KEY, str(DEFAULT_LOOKUP_KEYS)))


def write_sorted(df: DataFrame, rows: int, path: str, *keys: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """``df`` (``rows`` rows) as Parquet files of key ranges. Rows of a key that fill more than a
    file are split by the further keys."""
    files = max(1, -(-rows // rows_per_file))
    (df.repartitionByRange(files, *keys).sortWithinPartitions(*keys)
     .write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(path))


def any_of(column: str, values: list) -> Column:
    """Equal to one of ``values``: comparisons, which are pushed down whatever their number
    (a long IN list is pushed as its range only), in a balanced tree."""
    parts = [F.col(column) == F.lit(v) for v in values]
    if not parts:
        return F.lit(False)
    while len(parts) > 1:
        parts = [reduce(lambda a, b: a | b, parts[i: i + 2]) for i in range(0, len(parts), 2)]
    return parts[0]


def looked_up(table: DataFrame, column: str, keys: DataFrame, key: str, bound: int | None = None) -> DataFrame:
    """Rows of ``table`` that may match ``keys``: filtered if there are few distinct keys (at most
    lookup_keys are collected to see it), all rows otherwise. ``bound``: keys at most, if known."""
    most = lookup_keys(table.sparkSession)
    if bound is not None and bound > 100 * most:  # no need to look
        return table
    found = [r[0] for r in keys.select(key).where(F.col(key).isNotNull()).distinct().limit(most + 1).collect()]
    return table if len(found) > most else table.where(any_of(column, found))
