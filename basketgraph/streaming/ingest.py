"""Incremental loading: the batched ``INSERT ... ON CONFLICT DO NOTHING`` as a stream.

New CSV files of one entity that land in a folder are read by Structured Streaming; each
micro-batch keeps the first row per key (A2), drops keys the table already holds, and is
written to its own ``batch_id=<n>`` folder of the target table. Re-running a batch after a
failure overwrites that folder, so a replay never duplicates rows (exactly-once through
the checkpoint plus an idempotent per-batch write).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..layout import KEYS, OLIST_LAYOUT
from ..operators.loading import load_ignore_duplicates
from ..sources.entities import CSV_CASTS


def header_schema(spark: SparkSession, source_dir: str) -> str:
    """DDL of the files' own columns in their order, all as text, from their header."""
    names = spark.read.option("header", True).option("escape", '"').csv(source_dir).columns
    return ", ".join(f"`{n}` string" for n in names)


def _logical(df: DataFrame, layout: dict, entity: str) -> DataFrame:
    _, cols = layout[entity]
    picked = []
    for logical, physical in cols.items():
        c = F.col(f"`{physical}`")
        if logical in CSV_CASTS:
            c = c.cast(CSV_CASTS[logical])
        picked.append(c.alias(logical))
    return df.select(*picked)


def _stored(spark: SparkSession, target: str, batch_id: int) -> DataFrame:
    return spark.read.parquet(target).where(F.col("batch_id") != batch_id).drop("batch_id")


def start_incremental_load(spark: SparkSession, source_dir: str, entity: str, target: str,
                           layout: dict | None = None, keys: list[str] | None = None,
                           schema: str | None = None, checkpoint: str | None = None,
                           files_per_batch: int | None = None,
                           available_now: bool = True) -> StreamingQuery:
    """Start loading ``source_dir`` into the Parquet table at ``target``.

    Columns are found by name in the files' header; files whose header differs in order fail.
    The checkpoint lies beside the table unless given, so a later start goes on where the
    last one ended. ``available_now=True`` processes every file present and stops (a scheduled load);
    otherwise the query keeps watching the folder.
    """
    layout = layout or OLIST_LAYOUT
    keys = KEYS[entity] if keys is None else keys
    reader = (spark.readStream.schema(schema or header_schema(spark, source_dir))
              .option("header", True).option("escape", '"').option("enforceSchema", False)
              .option("mode", "FAILFAST"))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = _logical(reader.csv(source_dir), layout, entity)
    # The table starts as an empty batch, so every micro-batch can read what is stored.
    (spark.createDataFrame([], stream.schema).write.mode("ignore")
          .parquet(f"{target.rstrip('/')}/batch_id=-1"))

    def load_batch(batch: DataFrame, batch_id: int) -> None:
        kept = load_ignore_duplicates(batch, _stored(batch.sparkSession, target, batch_id), keys)
        kept.write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch_id={batch_id}")

    writer = (stream.writeStream.foreachBatch(load_batch)
              .option("checkpointLocation", checkpoint or f"{target.rstrip('/')}-checkpoint"))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def loaded_table(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).drop("batch_id")
