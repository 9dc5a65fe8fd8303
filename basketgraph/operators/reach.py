"""Shortest distances between customers, by breadth-first search in levels.

All pairs are searched in the same job a level, and a search belongs to its root, not to a
pair: state rows are (side, root, vertex), shared by all pairs that have the root on that side.

Two-sided (few pairs a root): searches run in lockstep from all distinct sources and from all
distinct targets. After k rounds each root has visited every vertex within k edges; if the true
distance D of a pair is at most 2k, some vertex of a shortest path lies on both sides, and
D = min over common vertices of d_source + d_target. So a pair is finished the first round its
two sides meet, and no search goes deeper than half the distance.

One-sided (many pairs a root): the graph is undirected, so either end may be the root. The side
with fewer distinct ends is searched; one target that all customers ask for costs what one
source that asks for all customers does. Roots whose ends are all found stop expanding.

Each root expands as a plain breadth-first search,

    frontier_k = neighbours(frontier_{k-1}) - level_{k-2} - level_{k-1}

(in an undirected graph a neighbour of a level-k vertex lies at level k-1, k or k+1, so
the growing visited set is never joined back). A round writes the new level to the
shared checkpoint folder with its row count observed during the write. A frontier that this
count allows is broadcast and the edges are scanned in place. A larger one is shuffled to a copy
of the edges that is dealt by source vertex once and kept (``Edges``); there the edges of a
vertex with very many stay spread over blocks. The loop ends when every pair is done, the
frontier is empty, or the length limit is reached.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import broadcast_if_small, max_broadcast_rows, pin, pin_metrics
from ..functions.skew import hot_key_rows
from ..store import OrderStore

# Vertex kinds of the typed graph.
CUSTOMER, ORDER, PRODUCT, SELLER = 0, 1, 2, 3
PK = ["source_id", "target_id"]
FORWARD, BACKWARD = 0, 1


def undirected(edges: DataFrame) -> DataFrame:
    """(src_t, src, dst_t, dst) in both directions."""
    back = edges.select(F.col("dst_t").alias("src_t"), F.col("dst").alias("src"),
                        F.col("src_t").alias("dst_t"), F.col("src").alias("dst"))
    return edges.select("src_t", "src", "dst_t", "dst").unionByName(back)


def _typed(df: DataFrame, a_t: int, a: str, b_t: int, b: str) -> DataFrame:
    return df.select(F.lit(a_t).alias("src_t"), F.col(a).alias("src"),
                     F.lit(b_t).alias("dst_t"), F.col(b).alias("dst"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


class Edges:
    """Undirected edges (src_t, src, dst_t, dst), with a copy dealt by source vertex that is made
    when a frontier is first too large to broadcast."""

    def __init__(self, df: DataFrame, hot_rows: int | None = None):
        self.df = df
        self.hot_rows = hot_rows or hot_key_rows(df.sparkSession)
        self._dealt: tuple | None = None

    def dealt(self) -> tuple[DataFrame, DataFrame, DataFrame, int]:
        """(edges of ordinary vertices by vertex, edges of hot vertices by vertex and block, the
        hot vertices with their blocks, their number)."""
        if self._dealt is None:
            conf = self.df.sparkSession.conf  # a copy in fewer partitions than a join starts with is shuffled again
            n = int(conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or conf.get("spark.sql.shuffle.partitions"))
            degree = self.df.groupBy("src_t", "src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > self.hot_rows)
            hot, n_hot = pin(degree.select(F.col("src_t").alias("h_t"), F.col("src").alias("h"),
                                           F.ceil(F.col("n") / self.hot_rows).cast("int").alias("blocks")), "hot-vertices")
            side = broadcast_if_small(hot, n_hot)  # at most edges / hot_rows vertices
            same = (F.col("src_t") == F.col("h_t")) & (F.col("src") == F.col("h"))
            # a fixed number of partitions: the joins below find the copy dealt as they need it
            cold = self.df.join(side, same, "left_anti").repartition(n, "src_t", "src").persist(StorageLevel.MEMORY_AND_DISK)
            spread = (self.df.join(side, same).withColumn("block", F.pmod(F.xxhash64("dst_t", "dst"), F.col("blocks")).cast("int"))
                      .select("src_t", "src", "block", "dst_t", "dst")
                      .repartition(n, "src_t", "src", "block").persist(StorageLevel.MEMORY_AND_DISK))
            self._dealt = cold, spread, hot, n_hot
        return self._dealt

    def unpersist(self) -> None:
        if self._dealt is not None:
            self._dealt[0].unpersist()
            self._dealt[1].unpersist()
            self._dealt = None

    def neighbours(self, frontier: DataFrame, rows: int) -> DataFrame:
        """``frontier`` (vt, vid and other columns, ``rows`` rows) with every neighbour as vt, vid."""
        carried = [c for c in frontier.columns if c not in ("vt", "vid")]
        at = (F.col("src_t") == F.col("vt")) & (F.col("src") == F.col("vid"))
        out = [*carried, F.col("dst_t").alias("vt"), F.col("dst").alias("vid")]
        if rows <= max_broadcast_rows(frontier.sparkSession):
            kinds = [r["vt"] for r in frontier.select("vt").distinct().collect()]  # tables of other kinds are not scanned
            return self.df.where(F.col("src_t").isin(kinds)).join(F.broadcast(frontier), at).select(*out)
        cold, spread, hot, n_hot = self.dealt()
        found = cold.join(frontier, at).select(*out)
        if n_hot:
            here = (frontier.join(broadcast_if_small(hot, n_hot), (F.col("vt") == F.col("h_t")) & (F.col("vid") == F.col("h")))
                    .withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*frontier.columns, "b"))
            found = found.unionByName(spread.join(here, at & (F.col("block") == F.col("b"))).select(*out))
        return found


ROOT_KEY = ["root", "vt", "vid"]
SIDE_KEY = ["side", *ROOT_KEY]
ONE_SIDED_FANOUT = 4


def one_sided_distances(edges: Edges | DataFrame, ends: DataFrame, root_vt: int, end_vt: int, max_len: int) -> DataFrame:
    """(root, end, dist) of every distinct (root, end) within ``max_len`` edges, by one search
    per root.

    Each level is written with its row count and the number of ends it reaches, observed
    during the write; roots whose ends are all found stop expanding.
    """
    edges = edges if isinstance(edges, Edges) else Edges(edges)
    wanted, n_ends = pin(ends.select("root", F.lit(end_vt).alias("vt"), F.col("end").alias("vid"), F.lit(1).alias("_t")),
                         "bfs-ends")
    side = broadcast_if_small(wanted, n_ends)
    hits = F.sum(F.coalesce(F.col("_t"), F.lit(0)))

    def flagged(df: DataFrame, depth: int) -> DataFrame:
        return df.join(side, ROOT_KEY, "left").withColumn("depth", F.lit(depth))

    def met(levels: list[DataFrame]) -> DataFrame:
        return _union([lv.where(F.col("_t") == 1).select(*ROOT_KEY, "depth") for lv in levels])

    start = wanted.select("root", F.lit(root_vt).alias("vt"), F.col("root").alias("vid")).distinct()
    level, seen = pin_metrics(flagged(start, 0), "bfs-level", hits=hits)
    levels = [level]
    rows, found = seen["rows"], seen["hits"] or 0
    for d in range(1, max_len + 1):
        if rows == 0 or found >= n_ends:
            break
        frontier = level.select(*ROOT_KEY)
        if found:
            # Roots with an end still open: at most n_ends rows, checked.
            open_roots = (wanted.join(broadcast_if_small(met(levels).select(*ROOT_KEY), found), ROOT_KEY, "left_anti")
                          .select("root").distinct())
            frontier = frontier.join(broadcast_if_small(open_roots, n_ends), "root", "left_semi")
        step = (edges.neighbours(frontier, rows).distinct()
                .join(_union([lv.select(*ROOT_KEY) for lv in levels[-2:]]), ROOT_KEY, "left_anti"))
        level, seen = pin_metrics(flagged(step, d), "bfs-level", hits=hits)
        levels.append(level)
        rows, found = seen["rows"], found + (seen["hits"] or 0)
    return met(levels).select("root", F.col("vid").alias("end"), F.col("depth").alias("dist"))


def _meets(pairs: DataFrame, new: DataFrame, levels: list[DataFrame], max_len: int) -> DataFrame:
    """(source_id, target_id, dist) of ``pairs`` whose two searches share a vertex, at least one
    of the two visits being in the newest level ``new``."""
    def visits(df: DataFrame, side: int, name: str) -> DataFrame:
        end = "source_id" if side == FORWARD else "target_id"
        return df.where(F.col("side") == side).select(F.col("root").alias(end), "vt", "vid", F.col("depth").alias(name))

    def common(forward: DataFrame, backward: DataFrame) -> DataFrame:
        return (pairs.join(visits(forward, FORWARD, "df"), "source_id")
                .join(visits(backward, BACKWARD, "db"), ["target_id", "vt", "vid"]).select(*PK, "df", "db"))

    both = common(new, _union([*levels, new])).unionByName(common(_union(levels), new))
    return (both.groupBy(*PK).agg(F.min(F.col("df") + F.col("db")).alias("dist"))
                .where(F.col("dist") <= max_len))


def two_sided_distances(edges: Edges | DataFrame, pairs: DataFrame, source_vt: int, target_vt: int,
                        max_len: int) -> DataFrame:
    """(source_id, target_id, dist) of distinct ``pairs``, searched from both ends."""
    edges = edges if isinstance(edges, Edges) else Edges(edges)
    p, n_pairs = pin(pairs.select(*PK), "bfs-pairs")

    def roots(of: DataFrame) -> DataFrame:
        return _union([of.select(F.lit(side).alias("side"), F.col(end).alias("root")).distinct()
                       for side, end in ((FORWARD, "source_id"), (BACKWARD, "target_id"))])

    kind = F.when(F.col("side") == FORWARD, source_vt).otherwise(target_vt)
    level, rows = pin(roots(p).select(*["side", "root"], kind.alias("vt"), F.col("root").alias("vid"), F.lit(0).alias("depth")),
                      "bfs-level")
    levels, results, done, left = [level], [], 0, p
    for k in range(1, math.ceil(max_len / 2) + 1):
        if rows == 0 or done >= n_pairs:
            break
        frontier = level.select(*SIDE_KEY)
        if done:
            # One row per finished pair (``done``, counted), checked before broadcasting.
            left = p.join(broadcast_if_small(_union([r.select(*PK) for r in results]), done), PK, "left_anti")
            frontier = frontier.join(broadcast_if_small(roots(left), 2 * (n_pairs - done)), ["side", "root"], "left_semi")
        step = (edges.neighbours(frontier, rows).distinct()
                .join(_union([lv.select(*SIDE_KEY) for lv in levels[-2:]]), SIDE_KEY, "left_anti"))
        level, rows = pin(step.withColumn("depth", F.lit(k)).select(*SIDE_KEY, "depth"), "bfs-level")
        met, n_met = pin(_meets(broadcast_if_small(left, n_pairs - done), level, levels, max_len), "bfs-meets")
        levels.append(level)
        results.append(met)
        done += n_met
    return _union(results) if results else p.where("false").select(*PK, F.lit(0).alias("dist"))


def pair_distances(edges: Edges | DataFrame, pairs: DataFrame, source_vt: int, target_vt: int,
                   max_len: int, strategy: str = "auto") -> DataFrame:
    """Shortest distance of every pair within ``max_len`` edges.

    ``strategy``: "bidirectional", "one_sided" (from the side with fewer distinct ends), or
    "auto" (one-sided when that side has on average at least ONE_SIDED_FANOUT pairs an end).

    edges  (src_t, src, dst_t, dst), already in both directions
    pairs  (source_id, target_id)
    returns (source_id, target_id, dist), no row for pairs farther apart than max_len
    """
    if strategy not in ("auto", "bidirectional", "one_sided"):
        raise ValueError(f"unknown strategy {strategy!r}")
    p = pairs.select(*PK).distinct()
    same = (F.col("source_id") == F.col("target_id")) if source_vt == target_vt else F.lit(False)
    # A pair whose ends are one vertex is at distance 0 and needs no search.
    zero = p.where(same).select(*PK, F.lit(0).alias("dist"))
    p = p.where(~same)
    if strategy != "bidirectional":
        counts = p.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_id").alias("s"),
                       F.count_distinct("target_id").alias("t")).first()
        fewest = min(counts["s"], counts["t"])
        if strategy == "one_sided" or counts["n"] >= ONE_SIDED_FANOUT * max(1, fewest):
            root, end = PK if counts["s"] <= counts["t"] else PK[::-1]
            kinds = (source_vt, target_vt) if root == "source_id" else (target_vt, source_vt)
            found = one_sided_distances(edges, p.select(F.col(root).alias("root"), F.col(end).alias("end")), *kinds, max_len)
            return zero.unionByName(found.select(F.col("root").alias(root), F.col("end").alias(end), "dist").select(*PK, "dist"))
    return zero.unionByName(two_sided_distances(edges, p, source_vt, target_vt, max_len))


def customer_hops(store: OrderStore, pairs: DataFrame, max_hops: int = 4,
                  strategy: str = "auto") -> DataFrame:
    """Least number of shared-product hops between two customers, up to ``max_hops``.

    One row per input pair (source_id, target_id, hops): 0 when both ids are equal (even
    for an unknown customer), NULL when the target is not reached within the limit.
    Customers are adjacent when they bought a common product; the search walks the
    customer-product graph, so hops = graph distance / 2.
    """
    p = pairs.select(*PK).distinct()
    dist = pair_distances(_edges(store, customer_product_edges), p, CUSTOMER, CUSTOMER, 2 * max_hops,
                          strategy)
    dist = dist.select(*PK, (F.col("dist") / 2).cast("int").alias("hops"))
    return p.join(dist, PK, "left")


def _edges(store: OrderStore, build) -> Edges:
    """The store's edges of one kind, so that their dealt copy is made once."""
    return store.kept_object(f"edges-{build.__name__}", lambda: Edges(build(store), store.hot_rows))


def customer_product_edges(store: OrderStore) -> DataFrame:
    """The customer-product graph of C8, both directions, over the store's kept weights."""
    return store.kept_object("customer-product-edges", lambda: undirected(
        _typed(store.customer_product_pairs(), CUSTOMER, "customer_id", PRODUCT, "product_id")))


def graph_edges(store: OrderStore) -> DataFrame:
    """The typed graph: customer-order, order-product, product-seller, both directions.
    The parts are kept with the store; the union of their directions is a view, never a copy."""
    def build():
        placed = store.known_orders()
        contains = store.order_products("bag").select("order_id", "product_id")
        sold_by = store.derived("sold-by", lambda: store.items("bag").select("product_id", "seller_id").distinct())
        return undirected(
            _typed(placed, CUSTOMER, "customer_id", ORDER, "order_id")
            .unionByName(_typed(contains, ORDER, "order_id", PRODUCT, "product_id"))
            .unionByName(_typed(sold_by, PRODUCT, "product_id", SELLER, "seller_id")))
    return store.kept_object("graph-edges", build)


def shortest_path_length(store: OrderStore, pairs: DataFrame, max_edges: int = 10,
                         strategy: str = "auto") -> DataFrame:
    """Least number of edges between two customers over all edge kinds, undirected,
    1 to ``max_edges``. Pairs with no such path get no row; equal endpoints are an error."""
    p = pairs.select("source_id", "target_id").distinct()
    if p.where(F.col("source_id") == F.col("target_id")).limit(1).count() > 0:
        raise ValueError("shortest path needs two different customers")
    known = store.customers.select(F.col("customer_id").alias("source_id"))
    p = p.join(known, "source_id", "left_semi").join(
        known.withColumnRenamed("source_id", "target_id"), "target_id", "left_semi")
    dist = pair_distances(_edges(store, graph_edges), p, CUSTOMER, CUSTOMER, max_edges, strategy)
    return dist.select(*PK, F.col("dist").cast("int").alias("length"))
