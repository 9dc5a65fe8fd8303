"""The property graph as vertex and edge DataFrames, and the rows it cannot hold.

    customer(customer_id, city)     seller(seller_id, city)     product(product_id, category)
    order(order_id)                 only for orders whose customer exists
    placed(customer_id, order_id)   one per order with a known customer
    contains(order_id, product_id, price)   merged: distinct (order, product, price), and only
                                    for items whose order, product and seller all exist
    sold_by(product_id, seller_id)  merged: distinct (product, seller), same condition
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import split_hot_join
from ..store import OrderStore


def build_vertices(store: OrderStore) -> dict[str, DataFrame]:
    """A5: one vertex frame per label (plus order vertices, created with their edge)."""
    return {
        "customer": store.customers.select("customer_id", "city"),
        "seller": store.sellers.select("seller_id", "city"),
        "product": store.products.select("product_id", "category"),
        "order": store.known_orders().select("order_id"),
    }


def vertex_table(store: OrderStore) -> DataFrame:
    """All vertices in one frame: (label, vertex_id, property) with the property as text."""
    v = build_vertices(store)
    return (v["customer"].select(F.lit("customer").alias("label"),
                                 F.col("customer_id").alias("vertex_id"),
                                 F.col("city").cast("string").alias("property"))
            .unionByName(v["seller"].select(F.lit("seller").alias("label"),
                                            F.col("seller_id").alias("vertex_id"),
                                            F.col("city").cast("string").alias("property")))
            .unionByName(v["product"].select(F.lit("product").alias("label"),
                                             F.col("product_id").alias("vertex_id"),
                                             F.col("category").cast("string").alias("property")))
            .unionByName(v["order"].select(F.lit("order").alias("label"),
                                           F.col("order_id").alias("vertex_id"),
                                           F.lit(None).cast("string").alias("property"))))


def build_placed_edges(store: OrderStore) -> DataFrame:
    """(customer_id, order_id); an order whose customer is unknown yields nothing."""
    return store.known_orders().select("customer_id", "order_id")


def build_contains_edges(store: OrderStore) -> DataFrame:
    """(order_id, product_id, price), merged on all three."""
    return store.items("merged").select("order_id", "product_id", "price")


def build_sold_by_edges(store: OrderStore) -> DataFrame:
    """(product_id, seller_id), merged."""
    return store.items("bag").select("product_id", "seller_id").distinct()


def unresolved_rows(store: OrderStore) -> DataFrame:
    """Every order or item row that a reference lookup drops, with the reason.

    (entity, order_id, customer_id, product_id, seller_id, reason); an item with two
    missing references appears once per reason.
    """
    o = store.orders.select("order_id", "customer_id")
    it = store.items_raw.select("order_id", "product_id", "seller_id")
    id_types = {c: t for c, t in o.dtypes + it.dtypes}

    def shaped(df: DataFrame, entity: str, reason: str) -> DataFrame:
        cols = [F.lit(entity).alias("entity")]
        for c in ("order_id", "customer_id", "product_id", "seller_id"):
            cols.append(F.col(c) if c in df.columns else F.lit(None).cast(id_types[c]).alias(c))
        return df.select(*cols, F.lit(reason).alias("reason"))

    def lost(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
        return split_hot_join(df, known.select(key), key, "left_anti", store.hot_rows)

    lost_orders = lost(o, store.customers, "customer_id")
    no_order = lost(it, store.known_orders(), "order_id")
    no_product = lost(it, store.products, "product_id")
    no_seller = lost(it, store.sellers, "seller_id")
    return (shaped(lost_orders, "orders", "unknown customer")
            .unionByName(shaped(no_order, "items", "unknown order"))
            .unionByName(shaped(no_product, "items", "unknown product"))
            .unionByName(shaped(no_seller, "items", "unknown seller")))
