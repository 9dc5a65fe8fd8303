"""Choosing query seeds from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw_key
from ..store import OrderStore, check_items_mode


def active_customers(store: OrderStore, min_items: int = 1, limit: int | None = 20,
                     items: str = "bag") -> DataFrame:
    """B1: customers with more than ``min_items`` items over all their orders, the
    ``limit`` smallest ids: (customer_id, n_items)."""
    check_items_mode(items)
    df = (store.customer_products(items).groupBy("customer_id")
          .agg(F.sum("w").cast("long").alias("n_items"))
          .where(F.col("n_items") > min_items))
    df = df.orderBy("customer_id")
    return df.limit(limit) if limit is not None else df


def popular_products(store: OrderStore, min_orders: int = 5, limit: int | None = 20,
                     items: str = "bag", distinct_orders: bool = False) -> DataFrame:
    """B2: products in more than ``min_orders`` item rows (or distinct orders), the
    ``limit`` smallest ids: (product_id, n_orders)."""
    check_items_mode(items)
    n = store.order_products(items)
    agg = F.count(F.lit(1)) if distinct_orders else F.sum("w")
    df = (n.groupBy("product_id").agg(agg.cast("long").alias("n_orders"))
          .where(F.col("n_orders") > min_orders)
          .orderBy("product_id"))
    return df.limit(limit) if limit is not None else df


def draw_seeds(pool: DataFrame, n: int, rng_seed: int, id_col: str) -> DataFrame:
    """A reproducible random sample of ``n`` rows of the pool (same seed, same rows)."""
    return (pool.withColumn("_draw", draw_key(id_col, rng_seed))
                .orderBy("_draw", id_col).limit(n).drop("_draw"))


def seed_pairs(pool: DataFrame, rng_seed: int, id_col: str, most: int = 10_000) -> DataFrame:
    """Pairs of two different pool members for two-customer queries: each drawn member
    with the next one in draw order, (source_id, target_id). At most ``most`` members are
    drawn (B3), so the ordering, which runs in one task, is bounded."""
    drawn = draw_seeds(pool.select(id_col), most, rng_seed, id_col)
    ranked = drawn.select(F.col(id_col).alias("source_id"),
                          draw_key(id_col, rng_seed).alias("_draw"))
    return (ranked.select("source_id", F.lead("source_id").over(
                Window.orderBy("_draw", "source_id")).alias("target_id"))
                  .where(F.col("target_id").isNotNull()))


def with_fallback(pool: DataFrame, fallback: list, min_rows: int, id_col: str) -> DataFrame:
    """The pool, or the fixed ids when the pool holds fewer than ``min_rows`` rows."""
    if pool.limit(min_rows).count() >= min_rows:
        return pool.select(id_col)
    field = pool.schema[id_col].dataType.simpleString()
    return pool.sparkSession.createDataFrame([(x,) for x in fallback], f"{id_col} {field}")
