"""Operator 8: approximate nearest neighbours with a forest of random-projection trees.

Trees are fitted on a bounded sample: a node splits at the median along the line through two
random points. Every vector is indexed in one leaf of each tree. A query walks all trees from
one shared priority queue, whose order is the smallest margin to a splitting plane on the way,
and collects leaves until their vectors reach the search budget; the candidates are reranked
by exact distance in double precision.

The budget is a share of the indexed vectors, measured on the sample: the smallest share at
which the walk finds ``recall`` of the true neighbours of sample points. Clustered data needs
a small share, data without structure a large one.

Equal vectors are one class that carries its k + 1 smallest ids, all that any query can need.
Leaves larger than BLOCK are split over tasks and their queries sent to each part; a task
keeps k + 1 candidates a query, so nothing but those is shuffled again.

Vectors are only near vectors of their own length; each length has its own forest.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, likewise rows with a null vec_id; ties go to the
smaller vec_id; a query gets all candidates if there are fewer than k; repeated rows are
candidates each (the query's own id is not); an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import kept
from .vectors import grouped, lengths, matrix, valid, vector_key

SAMPLE_ROWS = 16_384
LEAF_ROWS = 48  # of the sample
TREES = 8
BLOCK = 2048
PROBES = 128  # sample points whose neighbours set the budget


class Forest:
    """Complete binary trees: node i has children 2i + 1 and 2i + 2; leaves are numbered
    tree by tree."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = 0):
        self.depth = max(0, math.ceil(math.log2(max(1, len(sample)) / leaf_rows))) if len(sample) > leaf_rows else 0
        self.trees, self.leaves, self.inner = trees, 1 << self.depth, (1 << self.depth) - 1
        dim = sample.shape[1]
        self.line = np.zeros((trees, self.inner, dim))
        self.cut = np.zeros((trees, self.inner))
        rng = np.random.default_rng(seed)
        for t in range(trees):
            parts = {0: np.arange(len(sample))}
            for node in range(self.inner):
                rows = parts.pop(node)
                line = rng.standard_normal(dim)
                if len(rows) > 1:
                    p, q = rng.choice(rows, 2, replace=False)
                    if not np.array_equal(sample[p], sample[q]):
                        line = sample[p] - sample[q]
                line = line / np.linalg.norm(line)
                at = sample[rows] @ line
                cut = float(np.median(at)) if len(rows) else 0.0
                self.line[t, node], self.cut[t, node] = line, cut
                parts[2 * node + 1], parts[2 * node + 2] = rows[at <= cut], rows[at > cut]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf numbers, one column a tree."""
        out = np.zeros((len(x), self.trees), np.int64)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", x, self.line[t, node]) > self.cut[t, node]
                node = 2 * node + 1 + right
            out[:, t] = t * self.leaves + node - self.inner
        return out

    def margins(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.line.reshape(-1, x.shape[1]).T).reshape(len(x), self.trees, self.inner) - self.cut

    def walk(self, margin: np.ndarray) -> Iterator[int]:
        """Leaf numbers for one query, best first, from one queue over all trees."""
        queue = [(-math.inf, t, 0) for t in range(self.trees)]
        heapq.heapify(queue)
        while queue:
            bound, t, node = heapq.heappop(queue)
            if node >= self.inner:
                yield t * self.leaves + node - self.inner
                continue
            m = margin[t, node]
            near, far = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
            # priority is the smallest margin on the way, negated for the heap
            heapq.heappush(queue, (max(bound, -abs(m)), t, near))
            heapq.heappush(queue, (max(bound, abs(m)), t, far))


def search_share(forest: Forest, sample: np.ndarray, k: int, recall: float, probes: int = PROBES) -> float:
    """Smallest share of candidates (with repeats over trees) that finds ``recall`` of the k
    nearest in the sample, on average over ``probes`` of its points; at most 1 a tree."""
    n = len(sample)
    if n <= k + 1 or forest.depth == 0:
        return float(forest.trees)
    chosen = np.linspace(0, n - 1, min(probes, n)).astype(int)
    leaves = forest.leaf_of(sample)
    count = np.bincount(leaves.ravel(), minlength=forest.trees * forest.leaves)
    margins = forest.margins(sample[chosen])
    found = []
    for q, margin in zip(chosen, margins, strict=True):
        d = ((sample - sample[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        near = np.argpartition(d, k)[:k]
        order = np.fromiter(forest.walk(margin), np.int64)
        seen = np.empty(len(count))
        seen[order] = np.cumsum(count[order])
        found.append(seen[leaves[near]].min(axis=1))
    return float(np.quantile(np.concatenate(found), recall)) / n


def nearest(rows: DataFrame, is_query: Column, k: int = 10, recall: float = 0.97, trees: int = TREES,
            sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the k nearest found of each row
    of ``rows`` (vec_id, embedding) for which ``is_query`` holds."""
    ok = valid() & F.col("vec_id").isNotNull()
    keyed = rows.where(ok).select("vec_id", vector_key().alias("cid"), "embedding", is_query.alias("asked"))
    asked, _ = kept(keyed.where("asked").select(F.col("vec_id").alias("query_id"), F.col("cid").alias("q")), "queries")
    by_id = Window.partitionBy("cid").orderBy("vec_id")
    few = keyed.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1)
    classes, seen = kept(few.groupBy("cid").agg(
        F.first("embedding").alias("v"), F.min("vec_id").alias("least"),
        F.sort_array(F.collect_list("vec_id")).alias("ids")), "classes")
    if not seen["rows"]:
        return asked.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("vec_id"),
                            F.lit(0.0).alias("score")).limit(0)
    best = None
    for dim, n in lengths(classes):
        alike = classes.where(F.size("v") == dim)
        sample = alike.orderBy(F.xxhash64("cid"), "cid").limit(sample_rows).select("v").toPandas()["v"]
        sample = np.stack(sample.to_numpy()).astype(np.float64)
        forest = Forest(sample, trees)
        found = _found(alike, asked, forest, dim, search_share(forest, sample, k, recall) * n, k)
        best = found if best is None else best.unionByName(found)
    # (q, cid, dist) -> rows of the class, the k + 1 first, then those of each query
    ids = best.join(classes.select("cid", "ids"), "cid").select("q", "dist", F.explode("ids").alias("vec_id"))
    first = Window.partitionBy("q").orderBy("dist", "vec_id")
    ids = ids.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    answer = Window.partitionBy("query_id").orderBy("dist", "vec_id")
    return (asked.join(ids.drop("place"), "q").where("vec_id <> query_id")
            .withColumn("rank", F.row_number().over(answer)).where(F.col("rank") <= k)
            .select(F.col("query_id").cast("long"), "rank", F.col("vec_id").cast("long"), F.col("dist").alias("score")))


def _found(classes: DataFrame, asked: DataFrame, forest: Forest, dim: int, budget: float, k: int) -> DataFrame:
    """(q, cid, dist): for each query class the k + 1 nearest classes found."""
    sc = classes.sparkSession.sparkContext
    shared = sc.broadcast(forest)  # trees * 2**depth nodes, bounded by the sample
    kind = classes.schema["v"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = shared.value.leaf_of(matrix(batch.column(1), dim))
                offsets = np.arange(0, leaf.size + 1, leaf.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, leaf.ravel())],
                                                 names=["cid", "v", "least", "leaves"])

    placed, _ = kept(classes.select("cid", "v", "least").mapInArrow(
        place, f"cid long, v {kind}, least long, leaves array<long>"), "leaves")
    sizes = np.zeros(forest.trees * forest.leaves, np.int64)
    for row in placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().toLocalIterator():
        sizes[row["leaf"]] = row["count"]  # one number a leaf of the bounded forest
    blocks = np.maximum(1, -(-sizes // BLOCK))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            for s in range(0, batch.num_rows, 64):
                part = batch.slice(s, 64)
                margins = trees.margins(matrix(part.column(1), dim))
                row, leaf, block = [], [], []
                for i in range(part.num_rows):
                    got = 0
                    for number in trees.walk(margins[i]):
                        if sizes[number]:
                            row += [i] * int(blocks[number])
                            leaf += [number] * int(blocks[number])
                            block += range(int(blocks[number]))
                            got += sizes[number]
                            if got >= budget:
                                break
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf, pa.int64()), pa.array(block, pa.int64()), pa.array(np.ones(len(row), np.int32)),
                     part.column(0).take(at), part.column(1).take(at), part.column(0).take(at)],
                    names=["leaf", "block", "asked", "cid", "v", "least"])

    query_classes = classes.join(asked.select(F.col("q").alias("cid")).distinct(), "cid", "left_semi").select("cid", "v")
    visits = query_classes.mapInArrow(visit, f"leaf long, block long, asked int, cid long, v {kind}, least long")
    n_blocks = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), (F.col("leaf") + 1).cast("int")) \
        if int(blocks.max()) > 1 else F.lit(1)
    stored = placed.select("cid", "v", "least", F.explode("leaves").alias("leaf")).select(
        "leaf", F.pmod(F.xxhash64("cid", "leaf"), n_blocks).cast("long").alias("block"), F.lit(0).alias("asked"),
        "cid", "v", "least")
    keys = ["leaf", "block"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        held = 0

        def work(table: pa.Table, starts: np.ndarray) -> None:
            nonlocal held
            x, cid, least = matrix(table.column("v"), dim), table.column("cid").to_numpy(), table.column("least").to_numpy()
            is_query = table.column("asked").to_numpy() == 1
            for s, e in zip(starts, np.append(starts[1:], table.num_rows), strict=True):
                m = s + int(np.searchsorted(is_query[s:e], True))
                if s == m or m == e:
                    continue
                c, norms = x[s:m], (x[s:m] ** 2).sum(axis=1)
                for i in range(m, e, 256):
                    q = x[i: min(i + 256, e)]
                    rough = norms[None, :] + (q * q).sum(axis=1)[:, None] - 2 * q @ c.T
                    limit = np.partition(rough, min(k, len(c) - 1), axis=1)[:, min(k, len(c) - 1)]
                    slack = 1e-9 * (1 + norms.max() + (q * q).sum(axis=1).max())
                    r, col = np.nonzero(rough <= limit[:, None] + slack)
                    dist = np.sqrt(((q[r] - c[col]) ** 2).sum(axis=1))
                    bounds = np.searchsorted(r, np.arange(len(q) + 1))
                    for j in range(len(q)):
                        lo, hi = bounds[j], bounds[j + 1]
                        best.setdefault(int(cid[i + j]), []).append((dist[lo:hi], least[s + col[lo:hi]], cid[s + col[lo:hi]]))
                        held += hi - lo

        def flush() -> pa.RecordBatch:
            nonlocal held
            out = []
            for q, parts in best.items():
                dist, low, number = (np.concatenate(p) for p in zip(*parts, strict=True))
                _, unique = np.unique(number, return_index=True)
                order = unique[np.lexsort((low[unique], dist[unique]))][: k + 1]
                out.append((np.full(len(order), q), number[order], dist[order]))
            best.clear()
            held = 0
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q", "cid", "dist"])

        for _ in grouped(batches, keys, work):
            pass
        # (work keeps its results in ``best``)
        if best:
            yield flush()

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return search(batches)

    parts = stored.unionByName(visits).repartition(*keys).sortWithinPartitions(*keys, "asked").mapInArrow(
        bounded, "q long, cid long, dist double")
    near = parts.groupBy("q", "cid").agg(F.min("dist").alias("dist")).join(
        placed.select("cid", "least"), "cid")
    order = Window.partitionBy("q").orderBy("dist", "least")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).select("q", "cid", "dist")


def op8_vector_search(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, F.col("vec_id") % 100 == 0)
