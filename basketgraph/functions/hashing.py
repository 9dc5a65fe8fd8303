"""A reproducible pseudo-random order that any SQL engine can recompute.

``md5`` of the text form of the id plus a seed: identical in Spark and in other engines,
so a drawn sample can be checked against an independent SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(id_col: str, rng_seed: int) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{int(rng_seed)}")))
