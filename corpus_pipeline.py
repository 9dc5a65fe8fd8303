"""A corpus pipeline over ``documents``: toxicity filter, line deduplication, near-duplicate
removal, mixing of sources, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read back as
the next stage's ``docs``. All but the last return the columns of ``docs``. Other columns than
the ones a stage needs travel along as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketgraph.llm.jaccard_join import distinct_documents
from basketgraph.llm.line_dedup import dedup_lines
from basketgraph.llm.packing import byte_bpe, pack_documents
from basketgraph.llm.source_mix import label_quality, mixed_documents
from basketgraph.llm.tables import kept, tucked
from basketgraph.llm.toxicity import score, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5. Trained on the labels of ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    plain, restored = tucked(docs, "doc_id", "text")
    weights = train(docs.select("doc_id", "text"), labels)
    return restored(score(plain, weights).where("score < 0.5"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document holds are deleted; a document of which nothing
    is left goes. n_chars follows the text."""
    plain, restored = tucked(docs, "doc_id", "text", "n_chars")
    out = dedup_lines(plain).where("n_removed = 0 or n_removed < n_lines")
    return restored(out.withColumn("n_chars", F.when(
        F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group linked by five-word shingles at 0.8."""
    return distinct_documents(docs, 5, 80, 100)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 1, 2, 3 repeating; a document taken twice is two rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    plain, restored = tucked(docs, "doc_id", "text", "source", "n_chars")
    return restored(mixed_documents(plain, label_quality(labels)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    return pack_documents(docs.select("doc_id", "text"), byte_bpe())


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("source_mix", source_mix), ("packing", packing)]
# Training, alignment and tokenizing are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
