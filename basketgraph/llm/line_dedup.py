"""Operator 5: line deduplication by pairwise alignment.

Lines (without outer white space, blank ones left out) are hashed. A line that several
documents hold leads each later document to the first one that has it, so even a line found
everywhere costs one pair a document, never a pair of any two holders. So does a shortest run
of consecutive lines of at least ``least_words`` words, from each line on and up to each line:
every line of a block that any earlier document holds lies in such a run, whose first holder
may be another document than those of its lines. For each such pair the
sequences of repeated lines are aligned by patience diff, and what it leaves without unique
lines by longest common runs; runs of aligned lines that follow each other in both documents
form blocks, and blocks of at least ``least_words`` words are deleted from the later document.
The first holder of a line always keeps it. An alignment keeps the order and uses each line
once: of a passage that the later document holds more often than the earlier one, or in
another order, the rest stays.

Only hashes travel: a line or a run is 8 bytes, a document is the list of its repeated lines.
Grouping by line or run is an aggregate with map-side combining; the join back to the holders of
a hot one is broadcast if its measured size allows, else a shuffle join that AQE splits.

Defined cases: "earlier" is the smaller doc_id, null ids last, equal ids by a hash of the
text; repeated rows are one document and share one decision; null and empty texts have no
lines and stay as they are; lines repeated within one document only are left; an empty table
gives an empty result. Lines and runs are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .alignment import align
from .source_mix import n_words
from .tables import kept, small, tucked
from .text import mix

LEAST_WORDS = 30
BLANKS = " \t\r\x0b\x0c"


def document_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))


def line_table(docs: DataFrame) -> DataFrame:
    """(key, doc_id, pos, rank, line): lines that are not blank; pos counts all lines of the
    text, rank only these."""
    numbered = F.expr(f"filter(transform(split(text, '\\n'), (x, i) -> struct(i as pos, trim(BOTH '{BLANKS}' FROM x) as line)),"
                      " s -> s.line <> '')")
    return (docs.select(document_key().alias("key"), "doc_id", "text").where("text is not null")
            .select("key", "doc_id", F.posexplode(numbered).alias("rank", "s"))
            .select("key", "doc_id", "s.pos", "rank", "s.line"))


def blocks(a: list, b: list, least_words: int) -> list[int]:
    """Line numbers (pos) of ``b`` in blocks aligned with ``a``; both are lists of
    (rank, pos, hash, words) in order."""
    runs: list[list[tuple[int, int]]] = []
    for i, j in align([x[2] for x in a], [x[2] for x in b]):
        if runs and a[runs[-1][-1][0]][0] + 1 == a[i][0] and b[runs[-1][-1][1]][0] + 1 == b[j][0]:
            runs[-1].append((i, j))
        else:
            runs.append([(i, j)])
    return [b[j][1] for run in runs if sum(b[j][3] for _, j in run) >= least_words for _, j in run]


def least_runs(owner: np.ndarray, rank: np.ndarray, h: np.ndarray, words: np.ndarray,
               least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the shortest runs of consecutive lines with at least ``least_words``
    words, from each line on and up to each line; each once an owner. Lines are sorted by owner
    and rank, each has a word at least."""
    n = len(h)
    least = max(1, least_words)
    breaks = np.ones(n, bool)
    breaks[1:] = (owner[1:] != owner[:-1]) | (rank[1:] != rank[:-1] + 1)
    begins = np.flatnonzero(breaks)
    part = np.cumsum(breaks) - 1
    stops = np.append(begins[1:], n)
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    ends = np.searchsorted(total, total[:-1] + least, "left")
    from_each = np.flatnonzero(ends <= stops[part])
    starts = np.searchsorted(total, total[1:] - least, "right") - 1
    up_to = np.flatnonzero(starts >= begins[part])
    start = np.concatenate([from_each, starts[up_to]])
    width = np.concatenate([ends[from_each] - from_each, up_to + 1 - starts[up_to]])
    run = mix(width.astype(np.uint64))
    for k in range(int(width.max(initial=0))):
        live = np.flatnonzero(width > k)
        run[live] = mix(run[live] * np.uint64(0x9E3779B97F4A7C55) + h[start[live] + k])
    once = np.unique(np.rec.fromarrays([owner[start], run], names="owner,run"))
    return once.owner, once.run


def run_table(lists: DataFrame, least_words: int) -> DataFrame:
    """(key, doc_id, run): the runs of least_runs of each document. ``lists``: key, doc_id, lines."""
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(2)
            at = {name: lines.flatten().field(name).to_numpy(zero_copy_only=False) for name in ("rank", "h", "words")}
            owner = np.repeat(np.arange(len(lines)), lines.value_lengths().to_numpy(zero_copy_only=False))
            owner, run = least_runs(owner, at["rank"], at["h"].astype(np.int64).view(np.uint64), at["words"], least_words)
            owner = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner),
                                              pa.array(run.view(np.int64))], names=["key", "doc_id", "run"])

    kind = lists.schema["doc_id"].dataType.simpleString()
    return lists.select("key", "doc_id", "lines").mapInArrow(runs, f"key long, doc_id {kind}, run long")


def first_holders(rows: DataFrame, by: str) -> DataFrame:
    """(by, first): key of the first document of every ``by`` that several documents hold."""
    doc = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "key")
    return (rows.groupBy(by).agg(F.min(doc).alias("first"), F.max(doc).alias("last"))
            .where("first.key <> last.key").select(by, F.col("first.key").alias("first")))


def duplicate_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> tuple[DataFrame, int]:
    """(key, gone): line numbers to delete from documents that lose any, and their number."""
    rows = line_table(docs).select(
        "key", "doc_id", "rank", "pos", F.xxhash64("line").alias("h"), n_words("line").alias("words"))
    shared, n_shared = kept(first_holders(rows, "h"), "shared-lines")
    held, _ = kept(rows.join(small(shared, n_shared["rows"], 32), "h"), "repeated-lines")
    # a set: repeated rows share a key and bring each of its lines once, whatever their number
    lists = held.groupBy("key").agg(F.sort_array(F.collect_set(
        F.struct("rank", "pos", "h", "words"))).alias("lines"), F.first("doc_id").alias("doc_id"))
    lists, _ = kept(lists, "line-lists")
    runs, _ = kept(run_table(lists, least_words), "line-runs")
    firsts, n_firsts = kept(first_holders(runs, "run"), "shared-runs")
    by_run = runs.join(small(firsts, n_firsts["rows"], 32), "run")
    pairs = (held.select("key", "first").union(by_run.select("key", "first"))
             .where("key <> first").distinct())
    both = (pairs.join(lists.select(F.col("key").alias("first"), F.col("lines").alias("a")), "first")
            .join(lists.select("key", F.col("lines").alias("b")), "key").select("key", "a", "b"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        as_rows = lambda lines: [(x["rank"], x["pos"], x["h"], x["words"]) for x in lines]
        for frame in frames:
            out = [(key, gone) for key, a, b in frame.itertuples(index=False)
                   if (gone := blocks(as_rows(a), as_rows(b), least_words))]
            if out:  # an empty column of lists has no type
                yield pd.DataFrame({"key": pd.Series([k for k, _ in out], dtype="int64"), "gone": [g for _, g in out]})

    found = both.mapInPandas(run, "key long, gone array<int>")
    merged, seen = kept(found.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")),
                        "gone", size=F.sum(F.size("gone")))
    return merged, seen["rows"] + (seen["size"] or 0)


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the deduplicated ``text`` and added columns n_lines and n_removed, which
    stand for columns of these names, if there are any; others come along whatever their names."""
    docs, restored = tucked(docs.drop("n_lines", "n_removed"), "doc_id", "text")
    gone, size = duplicate_lines(docs, least_words)
    marked = gone.select(F.col("key").alias("line_key"), F.col("gone").alias("line_gone"))
    out = docs.withColumn("line_own", document_key()).join(
        small(marked, size, 32), F.col("line_own") == F.col("line_key"), "left")
    kept_lines = F.array_join(F.expr(
        "filter(split(text, '\\n'), (x, i) -> not array_contains(line_gone, i))"), "\n")
    text = F.when(F.col("line_gone").isNull(), F.col("text")).otherwise(kept_lines)
    n_lines = F.coalesce(F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")), F.lit(0))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(n_lines)
    out = out.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns],
                      n_lines.cast("long").alias("n_lines"),
                      F.coalesce(F.when(F.col("line_gone").isNotNull(), F.size("line_gone")), F.lit(0)).cast("long").alias("n_removed"))
    return restored(out, "n_lines", "n_removed")


def op5_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs)
