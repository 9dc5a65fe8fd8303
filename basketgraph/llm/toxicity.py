"""Operator 6: toxicity by FTRL-proximal logistic regression on hashed n-grams.

Features of a text: its words, word pairs and skip-grams (words one apart), hashed into
2**bits buckets, each present or not. FTRL-proximal (McMahan et al., 2013) gives every
coordinate its own learning rate, and its L1 term leaves most weights at exactly zero, so
the model is a small table that every scoring task can hold (at most 4 MB for 20 bits).

Training uses at most ``most_rows`` labelled documents (default 16,384), those with the
smallest hash of their id, so reruns agree; the learner is sequential and runs in one task
over that bound. Scoring covers every whole text, in map tasks without a shuffle.

Defined cases: a null or empty text has the intercept's score; null labels are ignored; of
several labels of a document the largest counts; documents with a null id are scored, never
trained on, and not held out; without any training row every score is 0; repeated rows are
each scored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import small_batches
from .text import PUNCT, mix, slices, text_buffer, word_hashes

BITS = 20
MOST_ROWS = 16_384
ROWS_PER_L1 = 2000  # the L1 term grows by 1 with so many training rows
NO_LABELS = -745.0  # an intercept whose logistic is 0


def feature_ids(words: np.ndarray, pointer: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every n-gram and skip-gram, with repeats."""
    owner = np.repeat(np.arange(len(pointer) - 1), np.diff(pointer))
    shift = np.uint64(64 - bits)
    owners, buckets = [owner], [mix(words) >> shift]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        same = owner[gap:] == owner[:-gap] if len(owner) > gap else np.zeros(0, bool)
        pair = words[:-gap][same] * np.uint64(salt) + mix(words[gap:][same]) if len(owner) > gap else np.zeros(0, np.uint64)
        owners.append(owner[:-gap][same] if len(owner) > gap else owner[:0])
        buckets.append(mix(pair) >> shift)
    return np.concatenate(owners), np.concatenate(buckets).astype(np.int64)


class Ftrl:
    """FTRL-proximal on binary features; the last coordinate is the intercept."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 1.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def intercept(self) -> float:
        return float(-self.z[-1] * self.alpha / (self.beta + np.sqrt(self.n[-1])))

    def learn(self, at: np.ndarray, label: float) -> None:
        w, b = self.weights(at), self.intercept()
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        m = self.n[-1]
        self.z[-1] += g - (np.sqrt(m + g * g) - np.sqrt(m)) / self.alpha * b
        self.n[-1] = m + g * g


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, most_rows: int = MOST_ROWS,
          epochs: int = 5) -> np.ndarray:
    """Weights (2**bits buckets, then the intercept) from ``labels`` (doc_id, toxic)."""
    small_batches(docs.sparkSession)
    chosen = (labels.where("doc_id is not null and toxic is not null").groupBy("doc_id")
              .agg(F.max("toxic").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
              .select(F.col("doc_id").alias("l_id"), "label"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, pointer, _, _ = word_hashes(*text_buffer(part.column(2)), PUNCT)
                owner, bucket = feature_ids(words, pointer, bits)
                seen = np.unique(owner << bits | bucket)
                ends = np.searchsorted(seen >> bits, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(ends.astype(np.int32), (seen & ((1 << bits) - 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["key", "label", "at"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), pa.schema([("key", pa.int64()), ("label", pa.float64()),
                                                               ("at", pa.list_(pa.int32()))])).slice(0, most_rows).combine_chunks()
        n = held.num_rows
        if not n:
            return
        labels, lists = held.column(1).to_numpy(), held.column(2).chunk(0)
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        model, order = Ftrl(1 << bits, l1=1.0 + n / ROWS_PER_L1), np.random.default_rng(0)
        for _ in range(epochs):
            for i in order.permutation(n):
                model.learn(values[offsets[i]: offsets[i + 1]], labels[i])
        w = model.weights()
        w[-1] = model.intercept()
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w[at])], names=["at", "w"])

    sample = (docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))
              .select(F.xxhash64("doc_id").alias("key"), F.col("label").cast("double"), F.col("text").cast("string").alias("text")))
    rows = sample.mapInArrow(features, "key long, label double, at array<int>")
    learned = rows.repartition(1).sortWithinPartitions("key", "label").mapInArrow(learn, "at int, w double")
    got = learned.toPandas()  # at most 2**bits + 1 rows
    weights = np.zeros((1 << bits) + 1)
    weights[got["at"].to_numpy()] = got["w"].to_numpy()
    if not len(got):
        weights[-1] = NO_LABELS
    return weights


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` (columns as they are, a string column text among them) with a column score."""
    small_batches(docs.sparkSession)
    bits = (len(weights) - 1).bit_length() - 1
    table = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = table.value
        for batch in batches:
            for part in slices(batch, "text"):
                words, pointer, _, _ = word_hashes(*text_buffer(part.column(at)), PUNCT)
                owner, bucket = feature_ids(words, pointer, bits)
                some = w[bucket] != 0
                seen = np.unique(owner[some] << bits | bucket[some])
                total = np.full(part.num_rows, w[-1])
                total += np.bincount(seen >> bits, w[seen & ((1 << bits) - 1)], part.num_rows)
                p = 1.0 / (1.0 + np.exp(-np.clip(total, -745, 745)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.where(total <= NO_LABELS, 0.0, p))], names=[*part.schema.names, "score"])

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("score", DoubleType()))


def score_toxicity(docs: DataFrame, labels: DataFrame, bits: int = BITS, most_rows: int = MOST_ROWS) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted. Rows whose id's checksum is
    divisible by 5 are held out of training."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = score(narrow, train(narrow, labels.select("doc_id", "toxic").where(~held), bits, most_rows))
    return scored.select("doc_id", held.alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def op6_toxicity(spark, sf_dir):
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                          spark.read.parquet(f"{sf_dir}/labels.parquet"))
