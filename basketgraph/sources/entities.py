"""A1: read the five entities, keep the listed columns, give them logical names."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..layout import ENTITIES, OLIST_LAYOUT, TESTDATA_LAYOUT

# CSV columns arrive as text; these logical columns get a typed cast.
CSV_CASTS = {"price": "double", "purchased_at": "timestamp"}


def _entity_path(root: str, stem: str, fmt: str) -> str:
    if fmt == "parquet" and not stem.endswith(".parquet"):
        stem = stem + ".parquet"
    return os.path.join(root, stem)


def read_entity(spark: SparkSession, root: str, entity: str, layout: dict | None = None,
                fmt: str = "parquet", multi_line: bool = False) -> DataFrame:
    """One entity as a DataFrame with logical column names.

    ``multi_line``: quoted values may hold line breaks. Such a file can't be split, so it is one
    task a file; without it a quoted line break fails the read.
    ``fmt="csv"`` reads a headered CSV (every column as text, no inference, malformed rows
    fail the read) and casts the typed columns; ``fmt="parquet"`` keeps the stored types.
    A missing folder or file fails with Spark's path-not-found error.
    """
    if layout is None:
        layout = OLIST_LAYOUT if fmt == "csv" else TESTDATA_LAYOUT
    stem, cols = layout[entity]
    path = _entity_path(root, stem, fmt)
    if fmt == "csv":
        raw = (spark.read.option("header", True).option("mode", "FAILFAST")
               .option("escape", '"').option("multiLine", multi_line).csv(path))
    elif fmt == "parquet":
        raw = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    picked = []
    for logical, physical in cols.items():
        c = F.col(f"`{physical}`")
        if fmt == "csv" and logical in CSV_CASTS:
            c = c.cast(CSV_CASTS[logical])
        picked.append(c.alias(logical))
    return raw.select(*picked)


def read_entities(spark: SparkSession, root: str, layout: dict | None = None,
                  fmt: str = "parquet") -> dict[str, DataFrame]:
    return {e: read_entity(spark, root, e, layout, fmt) for e in ENTITIES}
