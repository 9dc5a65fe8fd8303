"""Where each logical column lives in a physical data set.

The engine works on five logical entities with fixed logical column names:

    customers(customer_id, city)            products(product_id, category)
    sellers(seller_id, city)                orders(order_id, customer_id, status, purchased_at)
    items(order_id, product_id, seller_id, price)

A layout maps every logical entity to a physical table (file stem) and every logical
column to a physical column. It is plain data, so new sources only need a new dict.
"""

from __future__ import annotations

# File names and column names of the public Olist e-commerce CSV export,
# which the loaders read (only these five files and these columns are used).
OLIST_LAYOUT = {
    "customers": ("olist_customers_dataset.csv",
                  {"customer_id": "customer_id", "customer_unique_id": "customer_unique_id",
                   "city": "customer_city"}),
    "products": ("olist_products_dataset.csv",
                 {"product_id": "product_id", "category": "product_category_name"}),
    "sellers": ("olist_sellers_dataset.csv",
                {"seller_id": "seller_id", "city": "seller_city"}),
    "orders": ("olist_orders_dataset.csv",
               {"order_id": "order_id", "customer_id": "customer_id", "status": "order_status",
                "purchased_at": "order_purchase_timestamp"}),
    "items": ("olist_order_items_dataset.csv",
              {"order_id": "order_id", "product_id": "product_id", "seller_id": "seller_id",
               "price": "price"}),
}

# Stand-in mapping onto the TPC-H-like test tables (one parquet file per table).
TESTDATA_LAYOUT = {
    "customers": ("customer", {"customer_id": "c_custkey", "city": "c_nationkey"}),
    "products": ("part", {"product_id": "p_partkey", "category": "p_brand"}),
    "sellers": ("supplier", {"seller_id": "s_suppkey", "city": "s_nationkey"}),
    "orders": ("orders", {"order_id": "o_orderkey", "customer_id": "o_custkey",
                          "status": "o_orderstatus", "purchased_at": "o_orderdate"}),
    "items": ("lineitem", {"order_id": "l_orderkey", "product_id": "l_partkey",
                           "seller_id": "l_suppkey", "price": "l_extendedprice"}),
}

ENTITIES = ("customers", "products", "sellers", "orders", "items")

# Primary keys of the relational form (the items table has none: it is a bag).
KEYS = {
    "customers": ["customer_id"],
    "products": ["product_id"],
    "sellers": ["seller_id"],
    "orders": ["order_id"],
    "items": [],
}
