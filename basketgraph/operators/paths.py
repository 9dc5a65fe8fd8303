"""Recommendations 1 to 4 levels deep, by counting paths instead of listing them.

A depth-d query follows customer -> product -> other customer d-1 times and then
counts that last customer's items. With m(c, p) the item weight of customer c and
product p, and s the seed:

    g0(p)  = m(s, p)                                   depth 1 (own products)
    f_k(c) = sum_p g_{k-1}(p) * m(c, p),   c != s       paths reaching customer c after k hops
    g_k(p) = sum_c f_k(c) * m(c, p)
    answer = g_{d-1}

``mode="walk"`` (the relational form) only keeps every intermediate customer apart from
the seed; customers may repeat. ``mode="simple"`` (the graph form) needs the seed and all
intermediate customers pairwise distinct. With A(x, y) = sum_p m(x,p) m(y,p) and
sq(c) = A(c, c) the revisiting walks are removed in closed form:

    f2 = t2 - f1 * sq                          (drops c1 -> c -> c)
    f3 = t3 - f2 * sq - f1 * (N2 - f1^2)       (then c -> b -> c), N2(c) = sum_{b != c} A(c, b)^2

where t_k is the walk recurrence applied to f_{k-1}. N2 is needed only for customers
one hop from a seed. Each hop is a join of a per-seed vector with m and an
aggregation. The vector is written to the shared checkpoint folder, with its row count
observed during the write, and broadcast only when that count allows, so m is scanned
in place and never shuffled. The first vector (the seeds' own products) needs no write
when seeds x the widest customer's product count is already under the limit.

The last hop reaches the most rows. For a few seeds its vector has a column a seed, so a row of
m is joined and summed by product once for all seeds instead of once a seed that reaches it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import broadcast_if_small, max_broadcast_rows, pin
from ..store import OrderStore, check_items_mode
from .recommend import _finish, seed_frame

PATH_MODES = ("walk", "simple")
MAX_SIMPLE_DEPTH = 4
WIDE = "decimal(38,0)"
# Seeds at most that get a column each in the last hop.
MAX_SEED_COLUMNS = 32


def _spread_to_customers(g: DataFrame, g_rows: int, m: DataFrame) -> DataFrame:
    """t(seed_id, customer_id, w) = sum_p g(seed, p) * m(c, p), customers other than the seed."""
    return (m.join(broadcast_if_small(g.withColumnRenamed("w", "gw"), g_rows), "product_id")
             .where(F.col("customer_id") != F.col("seed_id"))
             .groupBy("seed_id", "customer_id")
             .agg(F.sum(F.col("gw") * F.col("w")).alias("w")))


def _spread_to_products(f: DataFrame, f_rows: int, m: DataFrame) -> DataFrame:
    """g(seed_id, product_id, w) = sum_c f(seed, c) * m(c, p)."""
    return (m.join(broadcast_if_small(f.withColumnRenamed("w", "fw"), f_rows), "customer_id")
             .groupBy("seed_id", "product_id")
             .agg(F.sum(F.col("fw") * F.col("w")).alias("w")))


def _seed_columns(s: DataFrame, seed_rows: int | None) -> list:
    """The seeds, if the caller knows that they are few, more than one, and they are; else none."""
    if seed_rows is None or not 1 < seed_rows <= MAX_SEED_COLUMNS:
        return []
    found = [r[0] for r in s.where(F.col("seed_id").isNotNull()).limit(MAX_SEED_COLUMNS + 1).collect()]
    return found if 1 < len(found) <= MAX_SEED_COLUMNS else []


def _spread_columns_to_products(f: DataFrame, m: DataFrame, seeds: list) -> DataFrame:
    """``_spread_to_products`` of a vector whose seeds all are in ``seeds``, by a column a seed."""
    names = [f"_w{i}" for i in range(len(seeds))]
    ids = [F.lit(x).cast(f.schema["seed_id"].dataType) for x in seeds]
    by_customer, rows = pin(
        f.groupBy("customer_id").agg(*[F.max(F.when(F.col("seed_id") == x, F.col("w"))).alias(n)
                                       for n, x in zip(names, ids, strict=True)]), "paths-columns")
    sums = (m.join(broadcast_if_small(by_customer, rows * len(seeds)), "customer_id")
             .groupBy("product_id").agg(*[F.sum(F.col(n) * F.col("w")).alias(n) for n in names]))
    cells = F.array(*[F.struct(x.alias("seed_id"), F.col(n).alias("w")) for n, x in zip(names, ids, strict=True)])
    return (sums.select("product_id", F.inline(F.filter(cells, lambda c: c["w"].isNotNull())))
            .select("seed_id", "product_id", "w"))


def _sum_by_customer(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("customer_id").agg(F.sum("v").alias("v"))


def dearer_products(store: OrderStore, mine: DataFrame) -> tuple[DataFrame, int]:
    """Products whose customer-by-customer expansion for ``mine`` (customer_id, product_id)
    emits more rows than their product-by-product weights, and their number."""
    widths = mine.groupBy("customer_id").agg(F.count(F.lit(1)).alias("width"))
    held = (mine.join(widths, "customer_id").groupBy("product_id")
            .agg(F.count(F.lit(1)).alias("holders"), F.sum("width").alias("own_rows")))
    return pin(store.product_degrees().join(held, "product_id")
               .where(F.col("holders") * F.col("customers") > F.col("pair_rows") + F.col("own_rows"))
               .select("product_id"), "dearer-products")


def pair_square_sums(store: OrderStore, customers: DataFrame, items: str,
                     hot_rows: int | None = None, wide: bool = False) -> DataFrame:
    """N2(customer_id, n2) = sum over other customers b of A(c, b)^2, for the given customers.

    ||A(c, .)||^2 is split by product, each on the cheaper of two ways by measured degrees.
    The customer-by-customer expansion of a product emits (given customers that hold it) x
    (all its customers) rows. The product-by-product weights B(h, x) = sum_b m(b, h) m(b, x)
    of a product emit one row per product of each of its customers, and its join with the
    given customers one row per product of theirs. A product for which the expansion is
    dearer is hot. So the rows of both parts together stay below twice the sum over
    customers of the square of their product count, however many customers hold a product:

        ||A(c, .)||^2 = sum_b A_cold(c, b)^2
                      + 2 sum_{h hot, p cold} m(c,h) m(c,p) B(h, p)
                      + sum_{h, h' hot} m(c,h) m(c,h') B(h, h')
        N2(c) = ||A(c, .)||^2 - sq(c)^2
    """
    m = store.customer_products(items)
    if wide:
        m = m.withColumn("w", F.col("w").cast(WIDE))
    mine, rows = pin(m.join(customers, "customer_id", "left_semi"), "n2-rows")
    # Their count is measured before any broadcast.
    hot, n_hot = dearer_products(store, mine) if hot_rows is None else store.hot_products(hot_rows)
    hot_side = broadcast_if_small(hot, n_hot)
    mine_cold = mine.join(hot_side, "product_id", "left_anti")
    m_cold = m.join(hot_side, "product_id", "left_anti") if n_hot else m
    a_cold = (m_cold.withColumnRenamed("customer_id", "b").withColumnRenamed("w", "bw")
              .join(broadcast_if_small(mine_cold, rows), "product_id")
              .groupBy("customer_id", "b").agg(F.sum(F.col("w") * F.col("bw")).alias("a")))
    parts = [a_cold.groupBy("customer_id").agg(F.sum(F.col("a") * F.col("a")).alias("v"))]
    if n_hot:
        m_hot = m.join(hot_side, "product_id", "left_semi")
        b_hx = (m_hot.select("customer_id", F.col("product_id").alias("h"), F.col("w").alias("hw"))
                .join(m, "customer_id")
                .groupBy("h", "product_id").agg(F.sum(F.col("hw") * F.col("w")).alias("bw")))
        mine_hot = mine.join(hot_side, "product_id", "left_semi").select(
            "customer_id", F.col("product_id").alias("h"), F.col("w").alias("hw"))
        cross = (mine_hot.join(mine_cold, "customer_id").join(b_hx, ["h", "product_id"])
                 .groupBy("customer_id")
                 .agg(F.sum(2 * F.col("hw") * F.col("w") * F.col("bw")).alias("v")))
        both_hot = (mine_hot.join(mine_hot.select("customer_id", F.col("h").alias("product_id"),
                                                  F.col("hw").alias("w")), "customer_id")
                    .join(b_hx, ["h", "product_id"])
                    .groupBy("customer_id")
                    .agg(F.sum(F.col("hw") * F.col("w") * F.col("bw")).alias("v")))
        parts += [cross, both_hot]
    sq = store.self_weight(items, wide)
    return (_sum_by_customer(parts).join(sq, "customer_id")
            .select("customer_id", (F.col("v") - F.col("sq") * F.col("sq")).alias("n2")))


def path_counts(store: OrderStore, seeds: DataFrame, depth: int, mode: str = "walk",
                items: str = "bag", hot_rows: int | None = None, wide: bool = False,
                seed_rows: int | None = None) -> DataFrame:
    """(seed_id, product_id, freq) for every product reached at the given depth.

    Counts are longs; an overflow raises (ANSI arithmetic). ``wide=True`` carries them, and
    every product of weights behind them, as decimal(38,0) instead."""
    check_items_mode(items)
    if mode not in PATH_MODES:
        raise ValueError(f"mode must be one of {PATH_MODES}, got {mode!r}")
    if depth < 1:
        raise ValueError("depth must be at least 1")
    if mode == "simple" and depth > MAX_SIMPLE_DEPTH:
        raise ValueError(f"simple paths are supported up to depth {MAX_SIMPLE_DEPTH}")
    s = seed_frame(seeds, seed_rows)
    m = store.customer_products(items)
    if wide:
        m = m.withColumn("w", F.col("w").cast(WIDE))
    weight = F.col("w").cast(WIDE) if wide else F.col("w")
    g = (store.weights_of(s, "seed_id", "customer_id", "customer_id", items, seed_rows)
         .join(s, F.col("customer_id") == F.col("seed_id")).select("seed_id", "product_id", weight.alias("w")))
    bound = None if seed_rows is None else seed_rows * store.degree_bound("products_per_customer")
    if bound is not None and bound <= max_broadcast_rows(store.spark):
        g_rows = bound          # proven small: used as is, no job
    else:
        g, g_rows = pin(g, "paths-g0")
    fs: list[DataFrame] = []
    columns = _seed_columns(s, seed_rows) if depth > 1 else []
    for hop in range(1, depth):
        holders = m
        if hop == 1:  # a few seeds' own products are looked up
            holders = store.weights_of(g, "product_id", "customer_id", "product_id", items, g_rows).withColumn("w", weight)
        t = _spread_to_customers(g, g_rows, holders)
        if mode == "simple" and hop >= 2:
            sq = store.self_weight(items, wide)
            prev = fs[-1].withColumnRenamed("w", "prev")
            fw = F.col("w") - F.coalesce(F.col("prev"), F.lit(0)) * F.col("sq")
            t = t.join(sq, "customer_id").join(prev, ["seed_id", "customer_id"], "left")
            if hop == 3:
                f1 = fs[0].withColumnRenamed("w", "f1")
                n2 = pair_square_sums(store, f1.select("customer_id").distinct(), items, hot_rows, wide)
                t = t.join(f1, ["seed_id", "customer_id"], "left").join(n2, "customer_id", "left")
                f1c = F.coalesce(F.col("f1"), F.lit(0))
                fw = fw - f1c * (F.coalesce(F.col("n2"), F.lit(0)) - f1c * f1c)
            t = t.select("seed_id", "customer_id", fw.alias("w"))
        if columns and hop == depth - 1:
            g = _spread_columns_to_products(t.where(F.col("w") > 0), m, columns)
            break
        f, f_rows = pin(t.where(F.col("w") > 0), f"paths-f{hop}")
        fs.append(f)
        g = _spread_to_products(f, f_rows, m)
        if hop < depth - 1:
            g, g_rows = pin(g, f"paths-g{hop}")
    return g.select("seed_id", "product_id", F.col("w").alias("freq"))


def neighbour_recs(store: OrderStore, seeds: DataFrame, depth: int = 2, mode: str = "walk",
                   items: str = "bag", k: int = 10, hot_rows: int | None = None,
                   wide: bool = False, seed_rows: int | None = None) -> DataFrame:
    """C6 (``mode="walk"``) and C7 (``mode="simple"``): top-k products at ``depth``."""
    return _finish(path_counts(store, seeds, depth, mode, items, hot_rows, wide, seed_rows),
                   k, wide)


def neighbour_recs_batched(store: OrderStore, seeds: DataFrame, depth: int = 2,
                           mode: str = "walk", items: str = "bag", k: int = 10,
                           seeds_per_job: int | None = None, path: str | None = None,
                           hot_rows: int | None = None, wide: bool = False) -> DataFrame:
    """C6/C7 for very many seeds: the per-level state is seeds x reached customers, so the
    seeds are spread over jobs of about ``seeds_per_job`` each (by a hash of the id, so no
    job sorts or collects the seed list). Every job appends its rows to one table under
    spark.checkpoint.dir (or ``path``); the result reads that table. Every seed is answered.

    By default a job takes as many seeds as keep its first-hop vector under the broadcast
    limit: one seed reaches at most (products per customer) x (customers per product)
    customers, by the store's degree counts.
    """
    from ..session import scratch_path

    if seeds_per_job is None:
        reach = max(1, store.degree_bound("products_per_customer")) * max(1, store.degree_bound("customers_per_product"))
        seeds_per_job = max(1, max_broadcast_rows(store.spark) // reach)
    distinct = seeds.select("seed_id").distinct()
    n = distinct.count()
    jobs = max(1, -(-n // seeds_per_job))
    path = path or scratch_path(store.spark, "recs")
    bucket = F.pmod(F.xxhash64("seed_id"), F.lit(jobs))
    for j in range(jobs):
        part = distinct.where(bucket == j)
        (neighbour_recs(store, part, depth, mode, items, k, hot_rows, wide)
         .write.mode("append").parquet(path))
    return store.spark.read.parquet(path)
