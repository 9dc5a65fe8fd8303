"""Product-by-product weights, for answers to every product or every customer in one job.

For weights w(g, p) of products in groups (customers, or orders) the co-occurrence weight is

    B(q, p) = sum over groups g of w(g, q) * w(g, p)

A group's products are gathered once into lots, one array of products a weight, and each product
of the group is sent the lots: rows (q, v, ps) say that q gains v with every product of ps. They
are dealt by q over as many tasks as the measured number of pairs asks for, and only there opened
and summed, so pairs are never written or sorted one by one. So that no task gets one key's pairs
whole, a large group is dealt into blocks of about ``block_rows`` products with a join key for each
pair of blocks, and the pairs of a product with very many are dealt further by the other product.
``pair_weights`` lists and stores q < p only; ``both_ways`` mirrors them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions import packed
from ..functions.ranking import top_k
from ..functions.sizing import broadcast_if_small, pin, pin_metrics
from ..functions.skew import SAMPLE_HITS
from ..session import small_batches
from ..store import OrderStore, check_items_mode

BLOCK_ROWS_KEY = "spark.basketgraph.pairBlockRows"
DEFAULT_BLOCK_ROWS = 1000
PAIRS_PER_TASK_KEY = "spark.basketgraph.pairsPerTask"
DEFAULT_PAIRS_PER_TASK = 2_000_000
# A task that sends lots holds about this many times the pairs of one that opens them.
SENT_PER_TASK = 10
# A task that sums packed lists takes this many times as many pairs.
PACKED_PER_TASK = 8
# Lists of summed pairs hold this many times ``block_rows`` rows.
LISTS_PER_BLOCK = 8
WIDE = "decimal(38,0)"


def block_rows_of(spark) -> int:
    return int(spark.conf.get(BLOCK_ROWS_KEY, str(DEFAULT_BLOCK_ROWS)))


def pairs_per_task(spark) -> int:
    return int(spark.conf.get(PAIRS_PER_TASK_KEY, str(DEFAULT_PAIRS_PER_TASK)))


def _tasks(spark, pairs: int, times: int = 1) -> int:
    return max(1, -(-pairs // (times * pairs_per_task(spark))))


def _large(rows: DataFrame, key: str, block_rows: int) -> tuple[DataFrame, int, int]:
    """Keys with more than ``block_rows`` rows and their blocks, their number and the sum of their
    rows squared."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows)
    large, seen = pin_metrics(sizes.select(key, F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"), "n"),
                              "large-groups", pairs=F.sum(F.col("n").cast("double") * F.col("n")))
    return broadcast_if_small(large.drop("n"), seen["rows"]), seen["rows"], int(seen["pairs"] or 0)  # at most rows / block_rows keys


def _block(p: str = "p"):
    return F.pmod(F.xxhash64(p), F.col("blocks")).cast("int")


def pair_lists(weights: DataFrame, group: str, block_rows: int | None = None) -> tuple[DataFrame, int]:
    """((q, v, ps), pairs): in some group of ``weights`` (group, product_id, w), which has one row
    per group and product, q meets each product of the array ps with weight v; q meets itself too."""
    spark = weights.sparkSession
    if block_rows is None:
        block_rows = block_rows_of(spark)
    rows = (weights.select(F.col(group).alias("g"), F.col("product_id").alias("p"), "w")
            .where("g is not null and p is not null"))
    side, n_large, pairs = _large(rows, "g", block_rows)
    cold = rows.join(side, "g", "left_anti") if n_large else rows
    held = cold.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("w", "p"))).alias("held"))
    lots = F.expr("transform(array_distinct(held.w), x -> named_struct('w', x, 'ps', "
                  "transform(filter(held, h -> h.w = x), h -> h.p)))")
    n = F.size("held").cast("long")
    baskets, seen = pin_metrics(held.select("g", "held", lots.alias("lots")), "baskets", pairs=F.sum(n * n))
    pairs += seen["pairs"] or 0
    lists = (baskets.repartition(_tasks(spark, seen["pairs"] or 0, SENT_PER_TASK), "g")
             .select(F.explode("held").alias("e"), "lots").select("e", F.explode("lots").alias("l"))
             .select(F.col("e.p").alias("q"), (F.col("e.w") * F.col("l.w")).alias("v"), F.col("l.ps").alias("ps")))
    if n_large:
        dealt = rows.join(side, "g").withColumn("own", _block())
        first = (dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                 .select("g", F.col("own").alias("i"), "j", F.col("p").alias("q"), "w"))
        second = (dealt.groupBy("g", "blocks", "own", F.col("w").alias("w2")).agg(F.sort_array(F.collect_list("p")).alias("ps"))
                  .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                  .select("g", "i", F.col("own").alias("j"), "w2", "ps"))
        lists = lists.unionByName(first.join(second, ["g", "i", "j"]).select("q", (F.col("w") * F.col("w2")).alias("v"), "ps"))
    return lists, pairs


def list_sums(lists: DataFrame, pairs: int, costs: DataFrame | None = None) -> DataFrame:
    """(q, p, w): the sums of ``lists`` (q, v, ps; about ``pairs`` pairs), each (q, p) once.
    Dealt by q, and for a q with more pairs than a few tasks take by a block j of p as well.
    ``costs``: (q, n), the pairs of each q, if known."""
    spark = lists.sparkSession
    most = 4 * pairs_per_task(spark)
    dealt, key = lists, ["q"]
    if pairs > most:
        if costs is None:
            costs = lists.groupBy("q").agg(F.sum(F.size("ps").cast("long")).alias("n"))
        hot, n_hot = pin(costs.where(F.col("n") > most).select("q", F.ceil(F.col("n") / most).cast("int").alias("blocks")), "hot-pairs")
        if n_hot:
            side = broadcast_if_small(hot, n_hot)  # at most pairs / most keys
            spread = (lists.join(side, "q").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                      .withColumn("ps", F.expr("filter(ps, x -> pmod(xxhash64(x), blocks) = j)"))
                      .where(F.size("ps") > 0).select("q", "v", "ps", "j"))
            dealt = lists.join(side, "q", "left_anti").withColumn("j", F.lit(0)).unionByName(spread)
            key = ["q", "j"]
    return (dealt.repartition(_tasks(spark, pairs), *key).select(*key, "v", F.explode("ps").alias("p"))
            .groupBy(*key, "p").agg(F.sum("v").alias("w")).select("q", "p", "w"))


def pair_weights(weights: DataFrame, group: str, block_rows: int | None = None) -> DataFrame:
    """(lo, hi, w), lo < hi: co-occurrence weights of ``weights`` (group, product_id, w), which
    has one row per group and product."""
    lists, pairs = pair_lists(weights, group, block_rows)
    later = lists.withColumn("ps", F.expr("filter(ps, x -> x > q)")).where(F.size("ps") > 0)
    return list_sums(later, pairs // 2).select(F.col("q").alias("lo"), F.col("p").alias("hi"), "w")


def lots_by(rows: DataFrame, key: str, value: str, block_rows: int | None = None) -> DataFrame:
    """``rows`` (key, value, w) as (key, w, ps): arrays of the values of a key with one weight, a
    key with more than ``block_rows`` rows in several."""
    if block_rows is None:
        block_rows = block_rows_of(rows.sparkSession)
    rows = rows.select(key, F.col(value).alias("p"), "w")
    side, n_large, _ = _large(rows, key, block_rows)
    gathered = F.sort_array(F.collect_list("p")).alias("ps")
    if not n_large:
        return rows.groupBy(key, "w").agg(gathered)
    return (rows.join(side, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", _block())
            .groupBy(key, "block", "w").agg(gathered).select(key, "w", "ps"))


def product_pairs(store: OrderStore, by: str = "customer", items: str = "bag",
                  block_rows: int | None = None) -> tuple[DataFrame, int]:
    """The store's (lo, hi, w) over customers or orders, written once and counted."""
    check_items_mode(items)
    if by not in ("customer", "order"):
        raise ValueError(f"by must be customer or order, got {by!r}")

    def build():
        weights = store.customer_products(items) if by == "customer" else store.order_products(items)
        return pin(pair_weights(weights, f"{by}_id", block_rows), f"pairs-{by}-{items}")

    return store.kept_object(f"pairs-{by}-{items}", build)


def both_ways(pairs: DataFrame, a: str = "seed_id", b: str = "product_id", w: str = "freq") -> DataFrame:
    """(a, b, w) of every pair in both directions."""
    return (pairs.select(F.col("lo").alias(a), F.col("hi").alias(b), F.col("w").alias(w))
            .unionByName(pairs.select(F.col("hi").alias(a), F.col("lo").alias(b), F.col("w").alias(w))))


def _gathered(rows: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` (g, x, w) as (g, j, xs, ws) with sorted xs, and (g, blocks) of the groups with more than
    ``block_rows`` rows, which are dealt into blocks j (None if there are none)."""
    side, n_large, _ = _large(rows, "g", block_rows)
    if n_large:
        rows = rows.join(side, "g", "left").withColumn("j", F.when(F.col("blocks") > 1, _block("x")).otherwise(0))
    else:
        rows = rows.withColumn("j", F.lit(0))
    held = rows.groupBy("g", "j").agg(F.sort_array(F.collect_list(F.struct("x", "w"))).alias("held"))
    return held.select("g", "j", F.col("held.x").alias("xs"), F.col("held.w").alias("ws")), side if n_large else None


def _met(keys: DataFrame, lists: DataFrame, large: DataFrame | None) -> DataFrame:
    """(ks, vs, ps, ws): each block of keys (g, xs, ws) with each block of the list (g, j, xs, ws) of its
    group; ``large``: the groups whose list has several blocks."""
    keys = keys.select("g", F.col("xs").alias("ks"), F.col("ws").alias("vs"))
    lists = lists.select("g", "j", F.col("xs").alias("ps"), "ws")
    if large is not None:
        keys = keys.join(large, "g", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        keys = keys.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    else:
        keys = keys.withColumn("j", F.lit(0))
    return keys.join(lists, ["g", "j"]).select("ks", "vs", "ps", "ws")


def basket_lists(weights: DataFrame, group: str, block_rows: int | None = None, sign: int = 1) -> tuple[DataFrame, int, int]:
    """((ks, vs, ps, ws), pairs, rows): the products of each group as keys and as list, from ``weights``
    (group, p, w) with one row per group and product; the weights of keys times ``sign``."""
    if block_rows is None:
        block_rows = block_rows_of(weights.sparkSession)
    rows = weights.select(F.col(group).alias("g"), F.col("p").alias("x"), "w").where("g is not null and x is not null")
    held, large = _gathered(rows, block_rows)
    n = F.size("xs").cast("long")
    blocks = F.lit(1)
    if large is not None:
        held = held.join(large, "g", "left")
        blocks = F.coalesce("blocks", F.lit(1))  # a block meets about so many of its size
    held, seen = pin_metrics(held.select("g", "j", "xs", "ws", blocks.alias("blocks")), "baskets", pairs=F.sum(n * n * blocks), items=F.sum(n))
    signed = F.transform("ws", lambda w: w * sign) if sign != 1 else F.col("ws")
    one = held.where("blocks = 1") if large is not None else held
    lists = one.select(F.col("xs").alias("ks"), signed.alias("vs"), F.col("xs").alias("ps"), "ws")
    if large is not None:
        many = held.where("blocks > 1")
        lists = lists.unionByName(_met(many.select("g", "xs", signed.alias("ws")), many, large))
    return lists, seen["pairs"] or 0, seen["items"] or 0


def packed_sums(lists: DataFrame, pairs: int, items: int, best: int | None = None, other: bool = False,
                list_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """The sums above 0 of ``lists`` (ks, vs, ps, ws: key ks[i] gains vs[i] * ws[j] with ps[j], ps sorted;
    about ``pairs`` pairs, ``items`` keys), all longs: with ``best`` the best of each key as (k, p, w, rank),
    otherwise all as (k, ps, ws), lists of at most ``list_rows``. ``other``: without a key's own value.

    Keys are dealt over as many tasks as the pairs ask for; a key with about as many as half a task
    takes is found from a sample and dealt over several by value."""
    spark = lists.sparkSession
    tasks, most = _tasks(spark, pairs, PACKED_PER_TASK), PACKED_PER_TASK * pairs_per_task(spark) // 2
    hot = []
    if pairs > most:
        fraction = min(1.0, SAMPLE_HITS * pairs / max(items, 1) / most)
        some = lists.select("ks", F.size("ps").cast("long").alias("n"))
        some = some.sample(fraction=fraction, seed=17) if fraction < 1 else some
        n = F.sum("n") / F.lit(fraction)
        found = (some.select(F.explode("ks").alias("k"), "n").groupBy("k").agg(n.alias("n")).where(F.col("n") > most)
                 .select("k", F.ceil(F.col("n") / most).cast("long").alias("parts")))
        hot = sorted(tuple(r) for r in found.collect())  # at most about pairs / most keys
    at = np.array([h[0] for h in hot], np.int64), np.array([h[1] for h in hot], np.int64)
    small_batches(spark)
    sent = lists.mapInArrow(lambda batches: packed.send(batches, tasks, at), packed.SENT)
    out = sent.repartitionById(tasks, "task").mapInArrow(lambda batches: packed.summed(batches, best, other, list_rows),
                                                         packed.LISTS if best is None else packed.BEST)
    if best is None or not hot:
        return out
    side = F.broadcast(spark.createDataFrame([(h[0],) for h in hot], "k long"))
    again = top_k(out.join(side, "k", "left_semi").drop("rank"), ["k"], "w", "p", best)
    return out.join(side, "k", "left_anti").unionByName(again)


class Codes:
    """Longs in the place of ids, in their order: whole numbers stand for themselves, others are numbered."""

    def __init__(self, ids: DataFrame):
        field = ids.schema.fields[0]
        self.kind, self.table, self.rows = field.dataType, None, 0
        if not isinstance(self.kind, IntegralType):
            name = field.name
            sorted_ids = ids.select(F.col(name).alias("_id")).where(F.col("_id").isNotNull()).distinct().orderBy("_id")
            self.table, self.rows = pin(sorted_ids.withColumn("_code", F.monotonically_increasing_id()), "codes")

    def coded(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """``df`` with the code of ``column`` as ``name`` in its place; rows without an id go."""
        others = [c for c in df.columns if c != column]
        if self.table is None:
            return df.where(F.col(column).isNotNull()).select(*others, F.col(column).cast("long").alias(name))
        return (df.join(broadcast_if_small(self.table, self.rows), F.col(column) == F.col("_id"))
                .select(*others, F.col("_code").alias(name)))

    def named(self, df: DataFrame, name: str, column: str) -> DataFrame:
        others = [c for c in df.columns if c != name]
        if self.table is None:
            return df.select(*others, F.col(name).cast(self.kind).alias(column))
        return (df.join(broadcast_if_small(self.table, self.rows), F.col(name) == F.col("_code"))
                .select(*others, F.col("_id").alias(column)))


def _ranked(best: DataFrame, seeds: Codes, products: Codes) -> DataFrame:
    named = products.named(seeds.named(best, "k", "seed_id"), "p", "product_id")
    return named.select("seed_id", "product_id", F.col("w").alias("freq"), "rank")


def also_bought_all(store: OrderStore, orders: str = "any", items: str = "bag", k: int = 10,
                    block_rows: int | None = None) -> DataFrame:
    """C1 and C2 with every product as seed: (seed_id, product_id, freq, rank). C2 takes the pairs
    of one order off again, in the same sums."""
    if orders not in ("any", "different"):
        raise ValueError(f"orders must be any or different, got {orders!r}")
    check_items_mode(items)
    if orders == "different":  # both weights are needed, and those of customers are made from those of orders
        store.order_product_weights()
    weights = store.customer_products(items)
    codes = Codes(weights.select("product_id"))
    lists, pairs, n = basket_lists(codes.coded(weights, "product_id", "p"), "customer_id", block_rows)
    if orders == "different":
        same, n_same, n_rows = basket_lists(codes.coded(store.order_products(items), "product_id", "p"), "order_id", block_rows, -1)
        lists, pairs, n = lists.unionByName(same), pairs + n_same, n + n_rows
    return _ranked(packed_sums(lists, pairs, n, k, other=True), codes, codes)


def bought_together_all(store: OrderStore, items: str = "bag", k: int = 10,
                        block_rows: int | None = None) -> DataFrame:
    """C3 with every product as seed: (seed_id, product_id, freq, rank)."""
    check_items_mode(items)
    weights = store.order_products(items)
    codes = Codes(weights.select("product_id"))
    return _ranked(packed_sums(*basket_lists(codes.coded(weights, "product_id", "p"), "order_id", block_rows), k, other=True), codes, codes)


def walk_counts_all(store: OrderStore, seeds: DataFrame, depth: int = 2, items: str = "bag",
                    wide: bool = False, block_rows: int | None = None) -> DataFrame:
    """(seed_id, product_id, freq): C6 walks of any number of seeds in one pass a level.

    With B(q, p) the customers between two products need not be listed. A walk may pass through
    every customer but the seed s, whose own share of B is taken off again:

        g_0(p) = m(s, p)
        g_k(p) = sum_q g_{k-1}(q) * B(q, p) - m(s, p) * sum_q g_{k-1}(q) * m(s, q)

    so a level joins each (seed, product) with the products met together with that product, at
    most all products, however many customers hold it. These lie in lots (arrays of one weight),
    which go to the seed unopened; the share taken off goes with them as a lot of one product.
    """
    if depth < 1:
        raise ValueError("depth must be at least 1")
    m = store.customer_products(items)
    if wide:
        m = m.withColumn("w", F.col("w").cast(WIDE))
    s = seeds.select("seed_id").distinct()
    own, n_own = pin(m.join(s, F.col("customer_id") == F.col("seed_id")).select("seed_id", "product_id", "w"), "walk-own")
    if depth == 1:
        return own.withColumnRenamed("w", "freq")
    pairs, n_pairs = product_pairs(store, "customer", items, block_rows)
    same = m.groupBy("product_id").agg(F.sum(F.col("w") * F.col("w")).alias("w"))
    between, _ = pin(lots_by(both_ways(pairs, "q", "p", "w").unionByName(
        same.select(F.col("product_id").alias("q"), F.col("product_id").alias("p"), "w")), "q", "p", block_rows)
        .select("q", F.col("w").alias("b"), "ps"), "walk-lots")
    met = between.groupBy("q").agg(F.sum(F.size("ps").cast("long")).alias("met"))
    g = own
    for hop in range(1, depth):
        back = (g.join(own.withColumnRenamed("w", "mine"), ["seed_id", "product_id"])
                .groupBy("seed_id").agg(F.sum(F.col("w") * F.col("mine")).alias("returns")))
        taken = own.join(back, "seed_id").select(F.col("seed_id").alias("q"), (-F.col("w") * F.col("returns")).alias("v"),
                                                 F.array("product_id").alias("ps"))
        level = g.select("seed_id", F.col("product_id").alias("q"), "w")
        costs, seen = pin_metrics(level.join(met, "q").groupBy(F.col("seed_id").alias("q")).agg(F.sum("met").alias("n")),
                                  "walk-costs", opened=F.sum("n"))
        opened = (seen["opened"] or 0) + n_own
        sent = _tasks(g.sparkSession, opened, SENT_PER_TASK)
        lists = (level.repartition(sent, "q").join(between.repartition(sent, "q"), "q")
                 .select(F.col("seed_id").alias("q"), (F.col("w") * F.col("b")).alias("v"), "ps")).unionByName(taken)
        g = list_sums(lists, opened, costs).where("w > 0").select(F.col("q").alias("seed_id"), F.col("p").alias("product_id"), "w")
        if hop < depth - 1:
            g, _ = pin(g, "walk-level")
    return g.withColumnRenamed("w", "freq")


def neighbour_recs_all(store: OrderStore, seeds: DataFrame, depth: int = 2, items: str = "bag", k: int = 10,
                       wide: bool = False, block_rows: int | None = None) -> DataFrame:
    """C6 (walks) for very many seeds, all customers included: top-k products a seed. The levels are
    those of ``walk_counts_all``, summed by ``packed_sums``; ``wide`` ones stay decimals."""
    if wide or depth < 2:
        out = top_k(walk_counts_all(store, seeds, depth, items, wide, block_rows), ["seed_id"], "freq", "product_id", k)
        freq = F.col("freq") if wide else F.col("freq").cast("long")
        return out.select("seed_id", "product_id", freq.alias("freq"), F.col("rank").cast("int").alias("rank"))
    if block_rows is None:
        block_rows = block_rows_of(store.spark)
    m = store.customer_products(items)
    s = seeds.select(F.col("seed_id").alias("customer_id")).distinct()
    products, people = Codes(m.select("product_id")), Codes(s)
    m = products.coded(m, "product_id", "p")
    own, n_own = pin(people.coded(m.join(s, "customer_id"), "customer_id", "s").select("s", "p", "w"), "walk-own")
    between, _ = pin(packed_sums(*basket_lists(m, "customer_id", block_rows), list_rows=LISTS_PER_BLOCK * block_rows), "walk-lists")
    sizes = between.groupBy(F.col("k").alias("p")).agg(F.count(F.lit(1)).cast("int").alias("blocks"), F.sum(F.size("ps").cast("long")).alias("met"))
    sizes, seen = pin_metrics(sizes, "walk-sizes", large=F.count(F.when(F.col("blocks") > 1, 1)))
    large = None
    if seen["large"]:
        large = broadcast_if_small(sizes.where("blocks > 1").select(F.col("p").alias("g"), "blocks"), seen["large"])
    lists = between.select(F.col("k").alias("g"), F.col("ps").alias("xs"), "ws")
    if large is None:
        lists = lists.withColumn("j", F.lit(0))
    else:
        lists = lists.join(large, "g", "left").withColumn("j", F.when(F.col("blocks") > 1, _block(F.col("xs")[0])).otherwise(0)).drop("blocks")
    taken, _ = _gathered(own.select(F.col("s").alias("g"), F.col("p").alias("x"), "w"), block_rows)
    g = own
    for hop in range(1, depth):
        back = (g.join(own.withColumnRenamed("w", "mine"), ["s", "p"]).groupBy(F.col("s").alias("g"))
                .agg(F.sum(F.col("w") * F.col("mine")).alias("returns")))
        off = taken.join(back, "g").select(F.array("g").alias("ks"), F.array(-F.col("returns")).alias("vs"), F.col("xs").alias("ps"), "ws")
        level = g.join(sizes, "p")
        seen = level.agg(F.sum("met").alias("pairs"), F.count(F.lit(1)).alias("rows")).first()
        keys, _ = _gathered(g.select(F.col("p").alias("g"), F.col("s").alias("x"), "w"), block_rows)
        sent = _met(keys.select("g", "xs", "ws"), lists, large).unionByName(off)
        out = packed_sums(sent, (seen["pairs"] or 0) + n_own, (seen["rows"] or 0) + n_own, k if hop == depth - 1 else None)
        if hop < depth - 1:
            rows = out.select(F.col("k").alias("s"), F.explode(F.arrays_zip("ps", "ws")).alias("r"))
            g, _ = pin(rows.select("s", F.col("r.ps").alias("p"), F.col("r.ws").alias("w")), "walk-level")
    return _ranked(out, people, products)
