"""Direct recommendation queries, for any number of seeds in one job.

Every operator takes a ``seeds`` DataFrame with a ``seed_id`` column and returns
``(seed_id, product_id, freq, rank)`` with the ``k`` best products per seed, ``freq``
descending and ``product_id`` ascending on ties.

The literal queries join item rows to item rows; here the item rows are first summed
into the weight tables of the store (m per customer and product, n per order and
product), and a pair of paths contributes the product of their weights. The number of
rows joined is then linear in the seed's neighbourhood, never the number of paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import top_k
from ..functions.sizing import bounded, broadcast_if_small, measured
from ..store import OrderStore, check_items_mode

ORDER_MODES = ("any", "different")


def seed_frame(seeds: DataFrame, seed_rows: int | None = None) -> DataFrame:
    """Distinct seeds, broadcast when small. ``seed_rows`` is a bound the caller can prove
    (a drawn sample, a limited pool); without it the seeds are counted first."""
    distinct = seeds.select("seed_id").distinct()
    if seed_rows is not None:
        return broadcast_if_small(distinct, seed_rows)
    return measured(distinct)


def _finish(pairs: DataFrame, k: int, wide: bool = False) -> DataFrame:
    out = top_k(pairs, ["seed_id"], "freq", "product_id", k)
    freq = F.col("freq") if wide else F.col("freq").cast("long")
    return out.select("seed_id", "product_id", freq.alias("freq"),
                      F.col("rank").cast("int").alias("rank"))


def _bound(store: OrderStore, seed_rows: int | None, degree: str) -> int | None:
    return None if seed_rows is None else seed_rows * store.degree_bound(degree)


def _also_bought_counts(store: OrderStore, seeds: DataFrame, items: str,
                        seed_rows: int | None = None) -> DataFrame:
    """(seed_id, product_id, freq): pairs of items of one customer, the first of the seed
    product, the second of another product, in any two orders (the same one included)."""
    m = store.weights_of(seeds, "seed_id", "customer_id", "product_id", items, seed_rows)
    n_buyers = _bound(store, seed_rows, "customers_per_product")
    buyers = bounded(
        m.join(seeds, F.col("product_id") == F.col("seed_id"))
         .select("seed_id", "customer_id", F.col("w").alias("w1")), n_buyers)
    return (buyers.join(store.weights_of(buyers, "customer_id", "customer_id", "customer_id", items, n_buyers), "customer_id")
            .where(F.col("product_id") != F.col("seed_id"))
            .groupBy("seed_id", "product_id")
            .agg(F.sum(F.col("w1") * F.col("w")).alias("freq")))


def _together_counts(store: OrderStore, seeds: DataFrame, items: str,
                     seed_rows: int | None = None) -> DataFrame:
    """(seed_id, product_id, freq): pairs of items in the same order."""
    n = store.weights_of(seeds, "seed_id", "order_id", "product_id", items, seed_rows)
    n_baskets = _bound(store, seed_rows, "orders_per_product")
    baskets = bounded(
        n.join(seeds, F.col("product_id") == F.col("seed_id"))
         .select("seed_id", "order_id", F.col("w").alias("w1")), n_baskets)
    return (baskets.join(store.weights_of(baskets, "order_id", "order_id", "order_id", items, n_baskets), "order_id")
            .where(F.col("product_id") != F.col("seed_id"))
            .groupBy("seed_id", "product_id")
            .agg(F.sum(F.col("w1") * F.col("w")).alias("freq")))


def customers_also_bought(store: OrderStore, seeds: DataFrame, orders: str = "any",
                          items: str = "bag", k: int = 10, seed_rows: int | None = None) -> DataFrame:
    """C1 (``orders="any"``) and C2 (``orders="different"``).

    ``any``: products bought by customers who bought the seed product, counting every
    pair of items, the same order included (the relational form).
    ``different``: the two items must sit in different orders of the customer (a path
    pattern may not use the customer-order edge twice); computed exactly as the
    ``any`` count minus the same-order count, keeping positive rows.
    """
    check_items_mode(items)
    if orders not in ORDER_MODES:
        raise ValueError(f"orders must be one of {ORDER_MODES}, got {orders!r}")
    s = seed_frame(seeds, seed_rows)
    counts = _also_bought_counts(store, s, items, seed_rows)
    if orders == "different":
        same = _together_counts(store, s, items, seed_rows).withColumn("freq", -F.col("freq"))
        counts = (counts.unionByName(same)
                  .groupBy("seed_id", "product_id").agg(F.sum("freq").alias("freq"))
                  .where(F.col("freq") > 0))
    return _finish(counts, k)


def bought_together(store: OrderStore, seeds: DataFrame, items: str = "bag",
                    k: int = 10, seed_rows: int | None = None) -> DataFrame:
    """Products found in the same order as the seed product."""
    check_items_mode(items)
    return _finish(_together_counts(store, seed_frame(seeds, seed_rows), items, seed_rows), k)


def own_products(store: OrderStore, seeds: DataFrame, items: str = "bag",
                 k: int = 10, seed_rows: int | None = None) -> DataFrame:
    """The seed customer's own products with their item counts."""
    check_items_mode(items)
    s = seed_frame(seeds, seed_rows)
    m = store.weights_of(s, "seed_id", "customer_id", "customer_id", items, seed_rows)
    own = (m.join(s, F.col("customer_id") == F.col("seed_id"))
            .select("seed_id", "product_id", F.col("w").alias("freq")))
    return _finish(own, k)


def city_category_recs(store: OrderStore, seeds: DataFrame, items: str = "bag",
                       k: int = 10, seed_rows: int | None = None) -> DataFrame:
    """C4: items bought by other customers of the seed's city, in the categories the seed
    bought. The seed's own products stay in when others bought them too.

    Computed as (city, product) totals minus the seed's own count: no customer-by-
    customer join, and one total per city however many seeds live there. A NULL city or
    category matches nothing.

    Customers keyed by person may have several cities. Persons with the same cities form one
    place; totals are by place, and a seed meets every place that shares a city with its own,
    so another person counts once however many cities are shared.
    """
    check_items_mode(items)
    s = seed_frame(seeds, seed_rows)
    m = store.customer_products(items)
    homes, spans = store.places()
    seed_place = bounded(
        s.join(homes, s.seed_id == homes.customer_id).select("seed_id", "place"), seed_rows)
    if spans is not None:
        near = spans.select(F.col("place").alias("own_place"), "city").join(spans, "city").select("own_place", "place").distinct()
        seed_place = measured(seed_place.withColumnRenamed("place", "own_place").join(near, "own_place")
                              .select("seed_id", "place"))
    # Customers of the seeds' places only, then (place, product) totals.
    place_customers = bounded(
        homes.join(seed_place.select("place").distinct(), "place", "left_semi"),
        _bound(store, seed_rows, "customers_per_city") if spans is None else None)
    totals = (m.join(place_customers, "customer_id")
               .groupBy("place", "product_id").agg(F.sum("w").alias("total")))
    own = (store.weights_of(s, "seed_id", "customer_id", "customer_id", items, seed_rows)
           .join(s, F.col("customer_id") == F.col("seed_id"))
           .select("seed_id", "product_id", F.col("w").alias("own")))
    cats = store.products.select("product_id", "category").where(F.col("category").isNotNull())
    # A seed meets only the totals of its places' products in its own categories.
    wanted = own.join(cats, "product_id").select("seed_id", "category").distinct().join(seed_place, "seed_id")
    wanted = bounded(wanted, _bound(store, seed_rows, "products_per_customer") if spans is None else None)
    recs = totals.join(cats, "product_id").join(wanted, ["place", "category"])
    if spans is not None:
        recs = recs.groupBy("seed_id", "product_id").agg(F.sum("total").alias("total"))
    recs = (recs.join(own, ["seed_id", "product_id"], "left")
            .select("seed_id", "product_id",
                    (F.col("total") - F.coalesce(F.col("own"), F.lit(0))).alias("freq"))
            .where(F.col("freq") > 0))
    return _finish(recs, k)
