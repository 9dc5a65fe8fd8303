"""Operator 4: embedding near-duplicates by iterative quantisation and Hamming tables.

From a bounded sample of unit vectors, ITQ learns rotations of the principal components under
which the signs are binary codes of little quantisation error. The code is cut into substrings,
one per table of a multi-index; two vectors meet in every table whose substring they share, and
are compared there with their original vectors in double precision. Substrings get longer
with the number of vectors (so buckets stay small), and there are as many tables as a pair
exactly at the threshold needs to meet in one of them with probability ``recall``.

That number follows from the pair's angle at the origin. Vectors are therefore encoded at unit
length, and no mean is taken off: either would change the angles, and links would be lost. The
price is that vectors with a strong common direction share more bits and buckets get larger.

Equal vectors are one class with a multiplicity. A bucket is compared in blocks of at most
BLOCK by BLOCK; a pair counts only in the first table where it meets, so no table of pairs is
ever written: a task sends each vector's number of links and a spanning forest of its links.

Vectors are only compared with vectors of their own length; each length has its own sample and
tables.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing, likewise rows with a null vec_id (their
component is their own id); repeated rows are equal vectors; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import components, kept, small
from .vectors import grouped, lengths, matrix, valid, vector_key

SAMPLE_ROWS = 8192
BLOCK = 1024


def unit_length(x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` (none all zero) at length 1; scaled first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn_itq(sample: np.ndarray, bits: int, rounds: int = 30, seed: int = 0) -> np.ndarray:
    """Projection: signs of unit_length(x) @ projection are the code of at least ``bits``
    bits. Each rotation gives as many bits as there are dimensions."""
    unit = unit_length(sample)
    _, axes = np.linalg.eigh(unit.T @ unit)  # principal axes, as columns
    reduced = unit @ axes
    rng = np.random.default_rng(seed)
    parts = []
    while sum(p.shape[1] for p in parts) < bits:
        rotation, _ = np.linalg.qr(rng.standard_normal((reduced.shape[1],) * 2))
        for _ in range(rounds):
            codes = np.where(reduced @ rotation >= 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(codes.T @ reduced)
            rotation = (u @ vt).T
        parts.append(axes @ rotation)
    return np.concatenate(parts, axis=1)[:, :bits]


def table_plan(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """(bits of a substring, tables) for n vectors."""
    width = min(24, max(6, round(math.log2(max(2, n))) - 2))
    meet = (1 - math.acos(cosine) / math.pi) ** width
    return width, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def substrings(x: np.ndarray, projection: np.ndarray, width: int) -> np.ndarray:
    """One int per table and vector."""
    bits = (unit_length(x) @ projection >= 0).reshape(len(x), -1, width)
    return (bits * (1 << np.arange(width))).sum(axis=2).astype(np.int32)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest label each of n nodes reaches over links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if np.array_equal(after, label):
            return label
        label = after


def _close_pairs(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, side: np.ndarray, cross: np.ndarray,
                 cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of rows of one group with at least ``cosine``; of a cross group only
    pairs of different sides."""
    unit = unit_length(x)
    left, right = [], []
    size = ends - starts
    for r in np.flatnonzero(size > 64):
        s, e = starts[r], ends[r]
        if cross[r]:
            m = s + int(np.searchsorted(side[s:e], 1))
            i, j = np.nonzero(unit[s:m] @ unit[m:e].T >= cosine)
            left.append(s + i)
            right.append(m + j)
        else:
            i, j = np.nonzero(np.triu(unit[s:e] @ unit[s:e].T >= cosine, 1))
            left.append(s + i)
            right.append(s + j)
    group = np.repeat(np.arange(len(starts)), size)
    few = np.flatnonzero((size <= 64)[group])
    for d in range(1, int(min(64, size.max(initial=1)))):
        a = few[few + d < len(x)]
        a = a[group[a] == group[a + d]]
        if not len(a):
            break
        ok = ~cross[group[a]] | (side[a] != side[a + d])
        a = a[ok]
        hit = np.einsum("ij,ij->i", unit[a], unit[a + d]) >= cosine
        left.append(a[hit])
        right.append(a[hit] + d)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def near_vectors(rows: DataFrame, cosine: float = 0.95, recall: float = 0.99,
                 sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept. ``rows``: vec_id, embedding."""
    ok = valid() & F.col("vec_id").isNotNull()
    keyed = rows.select("vec_id", F.when(ok, vector_key()).alias("cid"), "embedding")
    classes, _ = kept(keyed.where("cid is not null").groupBy("cid").agg(
        F.first("embedding").alias("v"), F.count(F.lit(1)).alias("copies")), "classes")
    own = keyed.select("vec_id", "cid")
    links = classes.select("cid", F.lit(0).cast("long").alias("links"), F.col("cid").alias("root")).where("false")
    for dim, n in lengths(classes):
        if n < 2:
            continue
        alike = classes.where(F.size("v") == dim)
        width, tables = table_plan(n, cosine, recall)
        sample = alike.orderBy(F.xxhash64("cid"), "cid").limit(sample_rows).select("v").toPandas()["v"]
        projection = learn_itq(np.stack(sample.to_numpy()).astype(np.float64), width * tables)
        links = links.unionByName(_linked(alike, dim, projection, width, tables, cosine))
    links, _ = kept(links, "links")
    edges = links.where("root <> cid").select(F.col("cid").alias("a"), F.col("root").alias("b"))
    roots, n_roots = kept(components(edges), "roots")
    found = links.groupBy("cid").agg(F.sum("links").alias("links"))
    table = (classes.select("cid", "copies").join(found, "cid", "left")
             .join(small(roots, n_roots["rows"], 24), F.col("cid") == F.col("node"), "left")
             .select(F.col("cid").alias("k"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                     F.coalesce("root", "cid").alias("root"))
             .where("n_links > 0"))
    table, n_table = kept(table, "linked")
    joined = own.join(small(table, n_table["rows"], 32), F.col("cid") == F.col("k"), "left")
    least, n_least = kept(joined.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("least"))
                          .withColumnRenamed("root", "r"), "least")
    component = F.coalesce("least", "vec_id")
    return (joined.join(small(least, n_least["rows"], 24), F.col("root") == F.col("r"), "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    component.alias("component_id"),
                    F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")))


def _linked(classes: DataFrame, dim: int, projection: np.ndarray, width: int, tables: int,
            cosine: float) -> DataFrame:
    """(cid, links, root): parts of each class's number of links, and a forest of the links."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = substrings(matrix(batch.column(1), dim), projection, width)
                offsets = np.arange(0, codes.size + 1, tables, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.ListArray.from_arrays(offsets, codes.ravel())],
                    names=["cid", "v", "copies", "codes"])

    kind = classes.schema["v"].dataType.simpleString()
    coded, _ = kept(classes.select("cid", "v", "copies").mapInArrow(
        encode, f"cid long, v {kind}, copies long, codes array<int>"), "codes")
    met = coded.select("*", F.posexplode("codes").alias("t", "bucket"))
    hot = met.groupBy("t", "bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    hot, n_hot = kept(hot.select(F.col("t").alias("ht"), F.col("bucket").alias("hb"), "blocks"), "hot-buckets")
    dealt = (met.join(small(hot, n_hot["rows"], 24), (F.col("t") == F.col("ht")) & (F.col("bucket") == F.col("hb")), "left")
             .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
             .withColumn("own", F.pmod(F.xxhash64("cid", "t"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("t", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     (F.col("own") > F.col("other")).cast("int").alias("side"), "cid", "v", "copies", "codes"))
    keys = ["t", "bucket", "i", "j"]

    def work(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch | None:
        ends = np.append(starts[1:], table.num_rows)
        i, j, t = (table.column(c).to_numpy() for c in ("i", "j", "t"))
        a, b = _close_pairs(matrix(table.column("v"), dim), starts, ends, table.column("side").to_numpy(),
                            (i != j)[starts], cosine)
        if not len(a):
            return None
        codes = table.column("codes").combine_chunks().flatten().to_numpy().reshape(-1, tables)
        earlier = np.arange(tables)[None, :] < t[a][:, None]
        first = np.ones(len(a), bool)
        for s in range(0, len(a), 100_000):
            e = s + 100_000
            first[s:e] = ~((codes[a[s:e]] == codes[b[s:e]]) & earlier[s:e]).any(axis=1)
        a, b = a[first], b[first]
        copies, cid = table.column("copies").to_numpy(), table.column("cid").to_numpy()
        count = (np.bincount(a, copies[b], table.num_rows) + np.bincount(b, copies[a], table.num_rows)).astype(np.int64)
        label = forest(a, b, table.num_rows)
        some = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(count[some]), pa.array(cid[label[some]])],
                                          names=["cid", "links", "root"])

    return (dealt.repartition(*keys).sortWithinPartitions(*keys, "side")
            .mapInArrow(lambda batches: grouped(batches, keys, work), "cid long, links long, root long"))


def op4_embedding_dedup(spark, sf_dir):
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
