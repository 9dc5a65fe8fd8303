"""The loaded store: five entities, reference resolution, and pre-aggregated weights.

Every recommendation query is a sum over paths customer - order - product - order -
customer ... . Those sums factor through two small weight tables that are built once
and reused by every query:

    m(customer_id, product_id, w)   item rows of a product over all orders of a customer
    n(order_id, product_id, w)      item rows of a product within one order

``items`` chooses what one item row is:

    "bag"     every row of the items table (the relational form; duplicates count)
    "merged"  distinct (order, product, price), as a graph merge of contains-edges would keep

References are resolved at load like a store with foreign keys: an order needs a known
customer, an item needs a known order, product and seller. Rows that fail are not lost:
``operators.graph.unresolved_rows`` returns them.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.lookup import ROWS_PER_FILE, looked_up, write_sorted
from .functions.sizing import broadcast_if_small, max_broadcast_rows, pin
from .functions.skew import hot_key_rows, hot_keys, split_hot_join
from .sources.entities import read_entities

ITEM_MODES = ("bag", "merged")


def check_items_mode(items: str) -> None:
    if items not in ITEM_MODES:
        raise ValueError(f"items must be one of {ITEM_MODES}, got {items!r}")


def rekey_customers(customers: DataFrame, orders: DataFrame, key: str,
                    hot_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Key customers by another column, such as the person behind per-order customer ids.

    Orders take the new key of their customer (orders of unknown customers drop out, as
    they would at resolution); customers become one row per new key, with the smallest
    city when the merged rows disagree. ``OrderStore.places`` holds all cities of a key.
    """
    mapping = customers.select(F.col("customer_id").alias("_cid"), F.col(key).alias("_key"))
    rekeyed = split_hot_join(orders.withColumnRenamed("customer_id", "_cid"), mapping, "_cid",
                             "inner", hot_rows)
    cols = [F.col("_key").alias("customer_id") if c == "customer_id" else F.col(c)
            for c in orders.columns]
    people = (customers.groupBy(F.col(key).alias("customer_id"))
              .agg(F.min("city").alias("city")))
    return people, rekeyed.select(*cols)


def unique_rows(df: DataFrame, key: str) -> DataFrame:
    """One row per id, as a unique id on load keeps; rows without an id resolve to nothing."""
    from .operators.loading import first_per_key

    return first_per_key(df.where(F.col(key).isNotNull()), [key]).select(*df.columns)


class OrderStore:
    def __init__(self, customers: DataFrame, products: DataFrame, sellers: DataFrame,
                 orders: DataFrame, items: DataFrame, resolve: bool = True,
                 hot_rows: int | None = None, customer_key: str = "customer_id"):
        self.cities = None
        if customer_key != "customer_id":
            self.cities = (customers.select(F.col(customer_key).alias("customer_id"), "city")
                           .where("customer_id is not null and city is not null").distinct())
            customers, orders = rekey_customers(customers, orders, customer_key, hot_rows)
        # Ids are unique in a store: of rows with one id the first (smallest) stays.
        self.customers = unique_rows(customers, "customer_id")
        self.products = unique_rows(products, "product_id")
        self.sellers = unique_rows(sellers, "seller_id")
        self.orders = unique_rows(orders, "order_id")
        self.orders_raw = orders
        self.items_raw = items
        self.resolve = resolve
        self.hot_rows = hot_rows
        self._memo: dict = {}
        self.path: str | None = None

    @property
    def spark(self) -> SparkSession:
        return self.items_raw.sparkSession

    @classmethod
    def from_dir(cls, spark: SparkSession, root: str, layout: dict | None = None,
                 fmt: str = "parquet", resolve: bool = True, hot_rows: int | None = None,
                 customer_key: str = "customer_id") -> "OrderStore":
        t = read_entities(spark, root, layout, fmt)
        return cls(t["customers"], t["products"], t["sellers"], t["orders"], t["items"],
                   resolve, hot_rows, customer_key)

    def _keep(self, key: str, df: DataFrame) -> DataFrame:
        if key not in self._memo:
            self._memo[key] = df.persist(StorageLevel.MEMORY_AND_DISK)
        return self._memo[key]

    def derived(self, key: str, build) -> DataFrame:
        """A table derived from the store, built on first use and kept."""
        if key not in self._memo:
            if self.path is None:
                self._keep(key, build())
            else:
                build().write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{key}")
                self._memo[key] = self.spark.read.parquet(f"{self.path}/{key}")
        return self._memo[key]

    def lazily(self, path: str | None = None, rows_per_file: int = ROWS_PER_FILE) -> "OrderStore":
        """A store over the same rows that writes each derived table, unique entity and sorted copy
        of a weight table as Parquet when a query first needs it (``materialize`` writes all of them
        at once). Nothing is held in executors, and a query that needs no weights builds none.
        Over more than ``rows_per_file`` items no sorted copies are written: see ``LazyStore``."""
        from .session import fine_shuffles, hashed_joins, scratch_path

        fine_shuffles(self.spark)
        hashed_joins(self.spark)
        out = LazyStore.__new__(LazyStore)
        out.__dict__.update(self.__dict__)
        out._memo, out.path = {}, (path or scratch_path(self.spark, "store")).rstrip("/")
        out.rows_per_file = rows_per_file
        return out

    def sorted_copy(self, base: str, column: str) -> DataFrame | None:
        """The copy of a weight table (cp, op) sorted by ``column``, in a materialised store."""
        own = "customer_id" if base == "cp" else "order_id"
        return self._memo.get(base if column == own else f"{base}-{column}") if f"{base}-product_id" in self._memo else None

    def materialize(self, path: str | None = None, graph: bool = False,
                    rows_per_file: int = ROWS_PER_FILE) -> "OrderStore":
        """Write the entities and the derived tables (resolved orders, weights, self-weights,
        and with ``graph=True`` the edge tables of the distance queries) as Parquet and return
        a store that reads them: the counterpart of loading a database once. The weights are
        written twice, sorted by either key, which is what an index would give: a few seeds
        are looked up in the copy sorted by their key (``weights_of``).

        The written store survives lost executors and new sessions without recomputing
        anything; ``path`` defaults to a fresh folder under spark.checkpoint.dir.
        """
        from .session import scratch_path

        path = (path or scratch_path(self.spark, "store")).rstrip("/")
        cp, op = self.customer_product_weights(), self.order_product_weights()
        n_cp, n_op = cp.count(), op.count()
        for name, df, rows, keys in (("cp", cp, n_cp, ("customer_id", "product_id")),
                                     ("cp-product_id", cp, n_cp, ("product_id", "customer_id")),
                                     ("op", op, n_op, ("order_id", "product_id")),
                                     ("op-product_id", op, n_op, ("product_id", "order_id"))):
            write_sorted(df, rows, f"{path}/{name}", *keys, rows_per_file=rows_per_file)
        entities = {"customers": self.customers, "products": self.products, "sellers": self.sellers,
                    "all-orders": self.orders}
        tables = {**entities, "orders": self.known_orders(),
                  "sq": self.self_weight("bag").join(self.self_weight("merged")
                                                      .withColumnRenamed("sq", "sq_merged"),
                                                      "customer_id")
                        .withColumnRenamed("sq", "sq_bag")}
        if graph:
            from .operators.reach import customer_product_edges, graph_edges
            tables["graph-edges"] = graph_edges(self)
            tables["customer-product-edges"] = customer_product_edges(self)
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        out = OrderStore.__new__(OrderStore)
        out.items_raw, out.resolve, out.hot_rows, out._memo = self.items_raw, self.resolve, self.hot_rows, {}
        out.cities, out.path = self.cities, None
        read = self.spark.read.parquet
        out.customers, out.products, out.sellers, out.orders = (read(f"{path}/{name}") for name in entities)
        out.orders_raw = out.orders
        for name in ("cp", "cp-product_id", "op", "op-product_id", *tables):
            if name not in entities:
                out._memo[name] = read(f"{path}/{name}")
        return out

    def unpersist(self) -> None:
        for v in self._memo.values():
            df = v[0] if isinstance(v, tuple) else v
            if hasattr(df, "unpersist"):
                df.unpersist()
        self._memo.clear()

    def places(self) -> tuple[DataFrame, DataFrame | None]:
        """((customer_id, place), (place, city)): customers with the same set of cities share a
        place. Customers of one city each have it as their place, and the second is None."""
        if self.cities is None:
            return (self.customers.where(F.col("city").isNotNull()).select("customer_id", F.col("city").alias("place")), None)

        def build():
            sets = self.cities.groupBy("customer_id").agg(F.sort_array(F.collect_set("city")).alias("cities"))
            return sets.withColumn("place", F.xxhash64("cities"))
        sets = self.derived("places", build)
        spans = sets.groupBy("place").agg(F.first("cities").alias("cities")).select("place", F.explode("cities").alias("city"))
        return sets.select("customer_id", "place"), spans

    # -- resolved relational tables ---------------------------------------------------

    def known_orders(self) -> DataFrame:
        """Orders whose customer exists: (order_id, customer_id)."""
        def build():
            o = self.order_customers()
            # One customer may place a large share of all orders.
            return self.with_known(o, self.customers, "customer_id") if self.resolve else o
        return self.derived("orders", build)

    def order_customers(self) -> DataFrame:
        return self.orders.select("order_id", "customer_id")

    def with_known(self, rows: DataFrame, entity: DataFrame, key: str) -> DataFrame:
        """The rows whose ``key`` is an id of ``entity``."""
        return split_hot_join(rows, entity.select(key), key, "left_semi", self.hot_rows)

    def resolved_items(self, orders: DataFrame | None = None) -> DataFrame:
        """Items whose order (with a known customer), product and seller all exist,
        carrying the order's customer: (order_id, customer_id, product_id, seller_id, price)."""
        it = self.items_raw.select("order_id", "product_id", "seller_id", "price")
        # One product, seller or order may hold a large share of all items.
        if self.resolve:
            it = self.with_known(it, self.products, "product_id")
            it = self.with_known(it, self.sellers, "seller_id")
        df = split_hot_join(it, self.known_orders() if orders is None else orders, "order_id", "inner", self.hot_rows)
        return df.select("order_id", "customer_id", "product_id", "seller_id", "price")

    def items(self, items: str = "bag") -> DataFrame:
        check_items_mode(items)
        df = self.resolved_items()
        if items == "merged":
            df = df.dropDuplicates(["order_id", "product_id", "price"])
        return df

    # -- weight tables ----------------------------------------------------------------
    # One pass over the items builds the (order, product) grain for both item modes; the
    # bag weight counts rows, the merged weight counts distinct prices (a NULL price is
    # one value, as in a distinct on (order, product, price)).

    def order_product_weights(self) -> DataFrame:
        """(order_id, customer_id, product_id, w_bag, w_merged), kept."""
        return self.derived("op", lambda: (
            self.resolved_items().groupBy("order_id", "customer_id", "product_id", "price")
            .agg(F.count(F.lit(1)).alias("rows"))
            .groupBy("order_id", "customer_id", "product_id")
            .agg(F.sum("rows").alias("w_bag"), F.count(F.lit(1)).alias("w_merged"))))

    def customer_product_weights(self) -> DataFrame:
        """(customer_id, product_id, w_bag, w_merged), kept."""
        return self.derived("cp", lambda: (
            self.order_product_weights().groupBy("customer_id", "product_id")
            .agg(F.sum("w_bag").alias("w_bag"), F.sum("w_merged").alias("w_merged"))))

    def customer_products(self, items: str = "bag") -> DataFrame:
        """m(customer_id, product_id, w): one row per pair with at least one item."""
        check_items_mode(items)
        return self.customer_product_weights().select(
            "customer_id", "product_id", F.col(f"w_{items}").alias("w"))

    def order_products(self, items: str = "bag") -> DataFrame:
        """n(order_id, product_id, w): item rows of a product inside one order."""
        check_items_mode(items)
        return self.order_product_weights().select(
            "order_id", "product_id", F.col(f"w_{items}").alias("w"))

    def weights_of(self, keys: DataFrame, key: str, group: str, column: str, items: str = "bag",
                   bound: int | None = None) -> DataFrame:
        """The rows of m (``group="customer_id"``) or n (``group="order_id"``) that ``keys`` may
        meet by ``column``: in a materialised store a few keys are pushed to the copy sorted by
        that column, otherwise all rows come back."""
        check_items_mode(items)
        base = "cp" if group == "customer_id" else "op"
        sorted_copy = self.sorted_copy(base, column)
        if sorted_copy is None:
            return self.customer_products(items) if base == "cp" else self.order_products(items)
        weights = sorted_copy.select(group, "product_id", F.col(f"w_{items}").alias("w"))
        return looked_up(weights, column, keys, key, bound)

    def self_weight(self, items: str = "bag", wide: bool = False) -> DataFrame:
        """sq(customer_id, sq) = sum over products of m(c,p)^2: the weight of the walks
        c - p - c that return to the same customer. ``wide``: decimals, not kept longs."""
        check_items_mode(items)
        if wide:
            w = F.col("w").cast("decimal(38,0)")
            return self.customer_products(items).groupBy("customer_id").agg(F.sum(w * w).alias("sq"))
        sq = self.derived("sq", lambda: (
            self.customer_product_weights().groupBy("customer_id")
            .agg(F.sum(F.col("w_bag") * F.col("w_bag")).alias("sq_bag"),
                 F.sum(F.col("w_merged") * F.col("w_merged")).alias("sq_merged"))))
        return sq.select("customer_id", F.col(f"sq_{items}").alias("sq"))

    def degree_bound(self, name: str) -> int:
        """The largest neighbourhood of a kind in the store, counted once."""
        def widest():
            if name == "customers_per_city":
                df, key = self.customers.where(F.col("city").isNotNull()), "city"
            else:
                key = "customer_id" if name == "products_per_customer" else "product_id"
                df = self.order_product_weights() if name == "orders_per_product" else self.customer_products()
            most = df.groupBy(key).agg(F.count(F.lit(1)).alias("d")).agg(F.max("d").alias("d")).first()["d"]
            return int(most or 0)
        return self.kept_object(f"degree-{name}", widest)

    def degree_bounds(self) -> dict[str, int]:
        """Largest neighbourhoods in the store: customers per product,
        orders per product, products per customer and customers per city. They bound the size of a seed's
        neighbourhood before it is computed (a hot key makes the bound large, and then
        the neighbourhood is counted instead)."""
        return {name: self.degree_bound(name) for name in
                ("customers_per_product", "orders_per_product", "products_per_customer", "customers_per_city")}

    def kept_object(self, key: str, build):
        """Anything built once for this store, such as a written table and its row count."""
        if key not in self._memo:
            self._memo[key] = build()
        return self._memo[key]

    def n_products(self) -> int:
        return self.kept_object("n-products", lambda: (self.products, self.products.count()))[1]

    def product_degrees(self) -> DataFrame:
        """(product_id, customers, pair_rows), kept: a product's customers, and how many products
        they have in all, which is what listing the product's co-occurrences costs."""
        def build():
            cp = self.customer_product_pairs()
            widths = cp.groupBy("customer_id").agg(F.count(F.lit(1)).alias("width"))
            return (cp.join(widths, "customer_id").groupBy("product_id")
                    .agg(F.count(F.lit(1)).alias("customers"), F.sum("width").alias("pair_rows")))
        return self.derived("product-degrees", build)

    def hot_products(self, hot_rows: int) -> tuple[DataFrame, int]:
        """Products bought by more than ``hot_rows`` customers, kept with their count."""
        key = f"hot-products-{hot_rows}"
        if key not in self._memo:
            hot = (self.customer_product_pairs().groupBy("product_id")
                   .agg(F.count(F.lit(1)).alias("deg")).where(F.col("deg") > hot_rows)
                   .select("product_id"))
            hot = hot.persist(StorageLevel.MEMORY_AND_DISK)
            self._memo[key] = (hot, hot.count())
        return self._memo[key]

    def customer_product_pairs(self) -> DataFrame:
        """Distinct (customer_id, product_id): the customer-product graph for reachability."""
        return self.customer_products("bag").select("customer_id", "product_id")


class LazyStore(OrderStore):
    """``OrderStore.lazily``: entities, too, are read from their written form.

    Sorting all weights pays for many lookups, not for the few of a query. So over more than
    ``rows_per_file`` items the customer weights are written once, clustered and sorted by customer,
    without the order weights before them, and lookups filter or join that table. Where a query asks
    for bag weights alone, the prices are not shuffled.
    """

    # A hot customer's rows are dealt over this many partitions by product.
    HOT_PARTS = 64

    def is_large(self) -> bool:
        return self.kept_object("n-items", lambda: self.items_raw.count()) > self.rows_per_file

    def sorted_copy(self, base: str, column: str) -> DataFrame:
        key = f"{base}-by-{column}"
        if key not in self._memo:
            df = self.customer_product_weights() if base == "cp" else self.order_product_weights()
            other = "product_id" if column != "product_id" else "customer_id" if base == "cp" else "order_id"
            write_sorted(df, df.count(), f"{self.path}/{key}", column, other, rows_per_file=self.rows_per_file)
            self._memo[key] = self.spark.read.parquet(f"{self.path}/{key}")
        return self._memo[key]

    def weights_of(self, keys: DataFrame, key: str, group: str, column: str, items: str = "bag",
                   bound: int | None = None) -> DataFrame:
        if not self.is_large():
            return super().weights_of(keys, key, group, column, items, bound)
        weights = self.customer_products(items) if group == "customer_id" else self.order_products(items)
        return looked_up(weights, column, keys, key, bound) if column == "customer_id" else weights

    # -- references: ids that are looked for are broadcast, or the few that are missing ------

    def order_customers(self) -> DataFrame:
        raw = self.orders_raw
        if "entity-orders" in self._memo or [c for c in raw.columns if c != "order_id"][0] != "customer_id":
            return super().order_customers()
        # The smallest row of an order is one of its smallest customer, NULL first.
        return (raw.where(F.col("order_id").isNotNull()).groupBy("order_id")
                .agg(F.max(F.col("customer_id").isNull()).alias("_none"), F.min("customer_id").alias("_first"))
                .select("order_id", F.when(~F.col("_none"), F.col("_first")).alias("customer_id")))

    def with_known(self, rows: DataFrame, entity: DataFrame, key: str) -> DataFrame:
        ids = entity.select(key)
        n_ids = ids.count()
        if n_ids <= max_broadcast_rows(self.spark):
            return rows.join(broadcast_if_small(ids, n_ids), key, "left_semi")
        rows = rows.where(F.col(key).isNotNull())
        lost, n_lost = self.kept_object(f"lost-{key}", lambda: pin(
            rows.select(key).distinct().join(ids, key, "left_anti"), "lost-ids"))
        if n_lost > max_broadcast_rows(self.spark):
            return super().with_known(rows, entity, key)
        return rows.join(broadcast_if_small(lost, n_lost), key, "left_anti") if n_lost else rows

    # -- customer weights without order weights ----------------------------------------------

    def customer_product_weights(self) -> DataFrame:
        if "cp" in self._memo or "op" in self._memo or not self.is_large():
            return super().customer_product_weights()
        return self.derived("cp", lambda: self._weights_by_customer(merged=True))

    def customer_products(self, items: str = "bag") -> DataFrame:
        if items != "bag" or "cp" in self._memo or "op" in self._memo or not self.is_large():
            return super().customer_products(items)
        cp = self.derived("cp-bag", lambda: self._weights_by_customer(merged=False))
        return cp.select("customer_id", "product_id", F.col("w_bag").alias("w"))

    def _weights_by_customer(self, merged: bool) -> DataFrame:
        """(customer_id, product_id, w_bag) and with ``merged`` w_merged, of resolved items."""
        orders = self._memo.get("orders")
        if orders is None:  # their shuffle by order serves the join
            orders = self.order_customers()
            orders = self.with_known(orders, self.customers, "customer_id") if self.resolve else orders
        it = self.resolved_items(orders)
        if merged:
            it = it.groupBy("order_id", "customer_id", "product_id", "price").agg(F.count(F.lit(1)).alias("rows"))
            weights = [F.sum("rows").alias("w_bag"), F.count(F.lit(1)).alias("w_merged")]
        else:
            weights = [F.count(F.lit(1)).alias("w_bag")]
        rows = it.select("customer_id", "product_id", *(["rows"] if merged else []))
        hot, n_hot = hot_keys(self.orders_raw, "customer_id",
                              hot_key_rows(self.spark) if self.hot_rows is None else self.hot_rows)
        by = ["customer_id"]
        if n_hot:
            rows = rows.join(broadcast_if_small(hot.withColumn("_hot", F.lit(True)), n_hot), "customer_id", "left")
            part = F.pmod(F.xxhash64("product_id"), F.lit(self.HOT_PARTS))
            rows, by = rows.withColumn("_part", F.when(F.col("_hot"), part).otherwise(F.lit(0))), ["customer_id", "_part"]
        return (rows.repartition(*by).groupBy(*by, "product_id").agg(*weights)
                .sortWithinPartitions("customer_id", "product_id").drop("_part"))


def _entity(name: str) -> property:
    return property(lambda store: store.derived(f"entity-{name}", lambda: store.__dict__[name]))


for _name in ("customers", "products", "sellers", "orders"):
    setattr(LazyStore, _name, _entity(_name))
