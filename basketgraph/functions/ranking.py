"""Top-k per group, the ``ORDER BY freq DESC LIMIT k`` of every recommendation query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, group: list[str], order_col: str = "freq", tie_col: str = "product_id",
          k: int = 10, rank_col: str = "rank") -> DataFrame:
    """Keep the ``k`` best rows per group, best first, ties broken by ``tie_col`` ascending.

    ``row_number() <= k`` over a window is planned as a partial WindowGroupLimit before the
    shuffle and a final one after it, so no task ever holds more than k rows per group and
    map task, however large one group is.
    """
    w = Window.partitionBy(*group).orderBy(F.col(order_col).desc(), F.col(tie_col).asc())
    return (df.withColumn(rank_col, F.row_number().over(w))
              .where(F.col(rank_col) <= k))
