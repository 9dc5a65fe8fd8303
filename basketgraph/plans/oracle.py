"""Equivalent SQL for every named plan, over the raw test tables (DuckDB dialect).

Where the join finishes, the SQL is the literal join of the original query (so it is
independent of the factored plans); depth 4 uses the same path-count recurrence written
in SQL. Sums are cast to BIGINT and ranks to INTEGER to match the Spark schemas.
"""

from __future__ import annotations

CUSTOMER_POOL = """customer_pool AS (
    SELECT o.o_custkey AS customer_id, CAST(COUNT(i.l_partkey) AS BIGINT) AS n_items
    FROM orders o JOIN lineitem i ON o.o_orderkey = i.l_orderkey
    GROUP BY o.o_custkey HAVING COUNT(i.l_partkey) > 1
    ORDER BY o.o_custkey LIMIT 20)"""

PRODUCT_POOL = """product_pool AS (
    SELECT l_partkey AS product_id, CAST(COUNT(l_orderkey) AS BIGINT) AS n_orders
    FROM lineitem GROUP BY l_partkey HAVING COUNT(l_orderkey) > 5
    ORDER BY l_partkey LIMIT 20)"""

ONE_CUSTOMER = CUSTOMER_POOL + """,
seed AS (SELECT customer_id AS seed_id FROM customer_pool
         ORDER BY md5(CAST(customer_id AS VARCHAR) || ':42'), customer_id LIMIT 1)"""

ONE_PRODUCT = PRODUCT_POOL + """,
seed AS (SELECT product_id AS seed_id FROM product_pool
         ORDER BY md5(CAST(product_id AS VARCHAR) || ':42'), product_id LIMIT 1)"""

ALL_CUSTOMERS = CUSTOMER_POOL + """,
seed AS (SELECT customer_id AS seed_id FROM customer_pool)"""

ALL_PRODUCTS = PRODUCT_POOL + """,
seed AS (SELECT product_id AS seed_id FROM product_pool)"""

# Item rows with their customer: every row of the items table (bag), or one row per
# distinct (order, product, price) (merged).
ROWS = """bag AS (
    SELECT o.o_custkey AS cust, o.o_orderkey AS ord, li.l_partkey AS part
    FROM lineitem li JOIN orders o ON o.o_orderkey = li.l_orderkey),
merged AS (
    SELECT DISTINCT o.o_custkey AS cust, o.o_orderkey AS ord, li.l_partkey AS part,
           li.l_extendedprice AS price
    FROM lineitem li JOIN orders o ON o.o_orderkey = li.l_orderkey)"""

TOPK = """
SELECT seed_id, product_id, CAST(freq AS BIGINT) AS freq, CAST(rank AS INTEGER) AS rank
FROM (SELECT seed_id, product_id, freq,
             ROW_NUMBER() OVER (PARTITION BY seed_id ORDER BY freq DESC, product_id) AS rank
      FROM counts) ranked
WHERE rank <= 10"""


def _pairs_by_customer(rows: str, other_order: bool) -> str:
    extra = " AND y.ord <> x.ord" if other_order else ""
    return f"""counts AS (
    SELECT s.seed_id, y.part AS product_id, COUNT(*) AS freq
    FROM seed s
    JOIN {rows} x ON x.part = s.seed_id
    JOIN customer k ON k.c_custkey = x.cust
    JOIN {rows} y ON y.cust = x.cust{extra}
    JOIN part pp ON pp.p_partkey = y.part
    WHERE y.part <> s.seed_id
    GROUP BY s.seed_id, y.part)"""


ALSO_BOUGHT_ANY = _pairs_by_customer("bag", False)
ALSO_BOUGHT_DIFFERENT = _pairs_by_customer("merged", True)

BOUGHT_TOGETHER = """counts AS (
    SELECT s.seed_id, y.part AS product_id, COUNT(*) AS freq
    FROM seed s
    JOIN bag x ON x.part = s.seed_id
    JOIN bag y ON y.ord = x.ord
    WHERE y.part <> s.seed_id
    GROUP BY s.seed_id, y.part)"""

CITY_CATEGORY = """seed_brands AS (
    SELECT DISTINCT s.seed_id, pp.p_brand AS brand
    FROM seed s JOIN bag x ON x.cust = s.seed_id JOIN part pp ON pp.p_partkey = x.part),
counts AS (
    SELECT s.seed_id, y.part AS product_id, COUNT(*) AS freq
    FROM seed s
    JOIN customer me ON me.c_custkey = s.seed_id
    JOIN customer nb ON nb.c_nationkey = me.c_nationkey AND nb.c_custkey <> me.c_custkey
    JOIN bag y ON y.cust = nb.c_custkey
    JOIN part pp ON pp.p_partkey = y.part
    JOIN seed_brands sb ON sb.seed_id = s.seed_id AND sb.brand = pp.p_brand
    GROUP BY s.seed_id, y.part)"""


def _own(rows: str) -> str:
    return f"""counts AS (
    SELECT s.seed_id, x.part AS product_id, COUNT(*) AS freq
    FROM seed s
    JOIN {rows} x ON x.cust = s.seed_id
    JOIN part pp ON pp.p_partkey = x.part
    GROUP BY s.seed_id, x.part)"""


OWN_PRODUCTS = _own("bag")
OWN_PRODUCTS_MERGED = _own("merged")


def _chain(rows: str, depth: int, simple: bool) -> str:
    """Literal paths: the seed's item rows, then (depth - 1) times an item row of the same
    product bought by another customer followed by any item row of that customer."""
    joins = [f"JOIN {rows} r0 ON r0.cust = s.seed_id"]
    conds = []
    last = "r0"
    for hop in range(1, depth):
        via, nxt = f"v{hop}", f"r{hop}"
        joins.append(f"JOIN {rows} {via} ON {via}.part = {last}.part")
        joins.append(f"JOIN {rows} {nxt} ON {nxt}.cust = {via}.cust")
        conds.append(f"{via}.cust <> s.seed_id")
        if simple:
            conds += [f"{via}.cust <> v{h}.cust" for h in range(1, hop)]
        last = nxt
    return f"""counts AS (
    SELECT s.seed_id, {last}.part AS product_id, COUNT(*) AS freq
    FROM seed s
    {chr(10).join('    ' + j for j in joins).strip()}
    JOIN part pp ON pp.p_partkey = {last}.part
    WHERE {' AND '.join(conds)}
    GROUP BY s.seed_id, {last}.part)"""


WALK_D2 = _chain("bag", 2, False)
WALK_D3 = _chain("bag", 3, False)

# Path counts carried level by level (the literal depth-4 join lists ~1e11 paths).
M_BAG = """m AS (SELECT cust AS c, part AS p, COUNT(*) AS w FROM bag GROUP BY cust, part)"""

M_MERGED = """m AS (SELECT cust AS c, part AS p, COUNT(*) AS w FROM merged GROUP BY cust, part)"""


def _to_customers(src: str, dst: str) -> str:
    return f"""{dst} AS (
    SELECT g.seed_id, m.c, SUM(g.w * m.w) AS w
    FROM {src} g JOIN m ON m.p = g.p
    WHERE m.c <> g.seed_id
    GROUP BY g.seed_id, m.c)"""


def _to_products(src: str, dst: str) -> str:
    return f"""{dst} AS (
    SELECT f.seed_id, m.p, SUM(f.w * m.w) AS w
    FROM {src} f JOIN m ON m.c = f.c
    WHERE f.w > 0
    GROUP BY f.seed_id, m.p)"""


G0 = """g0 AS (SELECT s.seed_id, m.p, m.w FROM seed s JOIN m ON m.c = s.seed_id)"""

WALK_D4 = ",\n".join([
    M_BAG, G0, _to_customers("g0", "f1"), _to_products("f1", "g1"),
    _to_customers("g1", "f2"), _to_products("f2", "g2"),
    _to_customers("g2", "f3"), _to_products("f3", "g3"),
    "counts AS (SELECT seed_id, p AS product_id, w AS freq FROM g3)"])

WALK_D3_COUNTED = ",\n".join([
    M_BAG, G0, _to_customers("g0", "f1"), _to_products("f1", "g1"),
    _to_customers("g1", "f2"), _to_products("f2", "g2"),
    "counts AS (SELECT seed_id, p AS product_id, w AS freq FROM g2)"])

SIMPLE_D2 = _chain("merged", 2, True)
SIMPLE_D3 = _chain("merged", 3, True)

SIMPLE_D4 = ",\n".join([
    M_MERGED,
    "sq AS (SELECT c, SUM(w * w) AS sq FROM m GROUP BY c)",
    G0, _to_customers("g0", "f1"), _to_products("f1", "g1"),
    _to_customers("g1", "t2"),
    """f2 AS (
    SELECT t.seed_id, t.c, t.w - COALESCE(f1.w, 0) * q.sq AS w
    FROM t2 t JOIN sq q ON q.c = t.c
    LEFT JOIN f1 ON f1.seed_id = t.seed_id AND f1.c = t.c)""",
    _to_products("f2", "g2"),
    _to_customers("g2", "t3"),
    """pair_a AS (
    SELECT x.c, y.c AS b, SUM(x.w * y.w) AS a
    FROM m x JOIN m y ON x.p = y.p AND x.c <> y.c
    WHERE x.c IN (SELECT c FROM f1)
    GROUP BY x.c, y.c)""",
    "n2 AS (SELECT c, SUM(a * a) AS n2 FROM pair_a GROUP BY c)",
    """f3 AS (
    SELECT t.seed_id, t.c,
           t.w - COALESCE(f2.w, 0) * q.sq
               - COALESCE(f1.w, 0) * (COALESCE(n2.n2, 0) - COALESCE(f1.w, 0) * COALESCE(f1.w, 0)) AS w
    FROM t3 t JOIN sq q ON q.c = t.c
    LEFT JOIN f2 ON f2.seed_id = t.seed_id AND f2.c = t.c AND f2.w > 0
    LEFT JOIN f1 ON f1.seed_id = t.seed_id AND f1.c = t.c
    LEFT JOIN n2 ON n2.c = t.c)""",
    _to_products("f3", "g3"),
    "counts AS (SELECT seed_id, p AS product_id, w AS freq FROM g3)"])


SIMPLE_D3_COUNTED = ",\n".join([
    M_MERGED,
    "sq AS (SELECT c, SUM(w * w) AS sq FROM m GROUP BY c)",
    G0, _to_customers("g0", "f1"), _to_products("f1", "g1"), _to_customers("g1", "t2"),
    """f2 AS (
    SELECT t.seed_id, t.c, t.w - COALESCE(f1.w, 0) * q.sq AS w
    FROM t2 t JOIN sq q ON q.c = t.c
    LEFT JOIN f1 ON f1.seed_id = t.seed_id AND f1.c = t.c)""",
    _to_products("f2", "g2"),
    "counts AS (SELECT seed_id, p AS product_id, w AS freq FROM g2)"])


def _rec(seed_cte: str, body: str) -> str:
    return f"WITH {seed_cte},\n{ROWS},\n{body}\n{TOPK}"


ACTIVE_CUSTOMERS = """seed AS (
    SELECT o.o_custkey AS seed_id
    FROM orders o JOIN lineitem i ON o.o_orderkey = i.l_orderkey
    GROUP BY o.o_custkey HAVING COUNT(i.l_partkey) > 1)"""

EVERY_PRODUCT = "seed AS (SELECT p_partkey AS seed_id FROM part)"

PAIRS = CUSTOMER_POOL + """,
pairs AS (
    SELECT source_id, target_id FROM (
        SELECT customer_id AS source_id,
               LEAD(customer_id) OVER (ORDER BY md5(CAST(customer_id AS VARCHAR) || ':42'),
                                       customer_id) AS target_id
        FROM customer_pool) t
    WHERE target_id IS NOT NULL)"""


SAME_CITY_PAIRS = ONE_CUSTOMER + """,
pairs AS (
    SELECT s.seed_id AS source_id, c2.c_custkey AS target_id
    FROM seed s
    JOIN customer c1 ON c1.c_custkey = s.seed_id
    JOIN customer c2 ON c2.c_nationkey = c1.c_nationkey AND c2.c_custkey <> c1.c_custkey)"""


def _hops_sql(levels: int = 4, pairs: str = PAIRS) -> str:
    ctes = [pairs, """cp AS MATERIALIZED (
    SELECT DISTINCT o.o_custkey AS c, i.l_partkey AS p
    FROM orders o JOIN lineitem i ON o.o_orderkey = i.l_orderkey)""",
            "n0 AS MATERIALIZED (SELECT DISTINCT source_id AS src, source_id AS c FROM pairs)",
            "v0 AS MATERIALIZED (SELECT src, c FROM n0)"]
    for k in range(1, levels + 1):
        ctes.append(f"""n{k} AS MATERIALIZED (
    SELECT r.src, b.c FROM n{k-1} r JOIN cp a ON a.c = r.c JOIN cp b ON b.p = a.p
    EXCEPT SELECT src, c FROM v{k-1})""")
        ctes.append(f"v{k} AS MATERIALIZED (SELECT src, c FROM v{k-1} UNION SELECT src, c FROM n{k})")
    dist = " UNION ALL ".join(f"SELECT src, c, {k} AS d FROM n{k}" for k in range(levels + 1))
    ctes.append(f"dist AS ({dist})")
    return ("WITH " + ",\n".join(ctes) + """
SELECT p.source_id, p.target_id, CAST(d.d AS INTEGER) AS hops
FROM pairs p LEFT JOIN dist d ON d.src = p.source_id AND d.c = p.target_id""")


RESOLVED_ITEMS = """known_orders AS (
    SELECT o_orderkey, o_custkey FROM orders o
    WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)),
items AS (
    SELECT i.* FROM lineitem i
    WHERE EXISTS (SELECT 1 FROM known_orders o WHERE o.o_orderkey = i.l_orderkey)
      AND EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = i.l_partkey)
      AND EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = i.l_suppkey))"""


def _path_length_sql(levels: int = 10, pairs: str | None = None) -> str:
    ctes = [pairs or PAIRS.replace("WHERE target_id IS NOT NULL)", """WHERE target_id IS NOT NULL
      AND source_id IN (SELECT c_custkey FROM customer)
      AND target_id IN (SELECT c_custkey FROM customer))"""),
            RESOLVED_ITEMS,
            """e1 AS (
    SELECT 0 AS st, o_custkey AS s, 1 AS dt, o_orderkey AS d FROM known_orders
    UNION SELECT 1, l_orderkey, 2, l_partkey FROM items
    UNION SELECT 2, l_partkey, 3, l_suppkey FROM items)""",
            "edges AS MATERIALIZED (SELECT st, s, dt, d FROM e1 UNION ALL SELECT dt, d, st, s FROM e1)",
            "n0 AS MATERIALIZED (SELECT DISTINCT source_id AS src, 0 AS t, source_id AS id FROM pairs)",
            "v0 AS MATERIALIZED (SELECT src, t, id FROM n0)"]
    for k in range(1, levels + 1):
        ctes.append(f"""n{k} AS MATERIALIZED (
    SELECT r.src, e.dt AS t, e.d AS id FROM n{k-1} r JOIN edges e ON e.st = r.t AND e.s = r.id
    EXCEPT SELECT src, t, id FROM v{k-1})""")
        ctes.append(f"v{k} AS MATERIALIZED (SELECT src, t, id FROM v{k-1} UNION SELECT src, t, id FROM n{k})")
    dist = " UNION ALL ".join(f"SELECT src, t, id, {k} AS d FROM n{k}" for k in range(levels + 1))
    ctes.append(f"dist AS ({dist})")
    return ("WITH " + ",\n".join(ctes) + """
SELECT p.source_id, p.target_id, CAST(d.d AS INTEGER) AS length
FROM pairs p JOIN dist d ON d.src = p.source_id AND d.t = 0 AND d.id = p.target_id""")


RUNS = """runs AS (
    SELECT event_type AS engine, 'Q' || CAST(user_id % 8 AS VARCHAR) AS query,
           CAST(event_id AS BIGINT) AS iteration, CAST(value AS DOUBLE) AS elapsed_ms,
           value < 0.1 AS failed
    FROM events),
flagged AS (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY engine, query ORDER BY iteration) <= 5 AS warm
    FROM runs)"""

SUMMARY = RUNS + """,
summary AS (
    SELECT engine, query,
           CAST(COUNT(elapsed_ms) FILTER (WHERE NOT warm) AS BIGINT) AS runs,
           CASE WHEN BOOL_OR(failed) OR COUNT(elapsed_ms) FILTER (WHERE NOT warm) = 0 THEN NULL
                ELSE ROUND(AVG(elapsed_ms) FILTER (WHERE NOT warm), 6) END AS mean_ms,
           CASE WHEN BOOL_OR(failed) OR COUNT(elapsed_ms) FILTER (WHERE NOT warm) = 0 THEN NULL
                ELSE ROUND(STDDEV_POP(elapsed_ms) FILTER (WHERE NOT warm), 6) END AS std_ms,
           BOOL_OR(failed) AS failed
    FROM flagged GROUP BY engine, query)"""

# The store that lacks some customers, products and sellers.
PARTIAL = """some_customers AS (SELECT * FROM customer WHERE c_nationkey < 20),
some_parts AS (SELECT * FROM part WHERE p_brand <> 'Brand#2'),
some_suppliers AS (SELECT * FROM supplier WHERE s_nationkey < 22),
"""
PARTIAL_ITEMS = PARTIAL + (RESOLVED_ITEMS.replace("FROM customer c", "FROM some_customers c")
                           .replace("FROM part p", "FROM some_parts p").replace("FROM supplier s", "FROM some_suppliers s"))

# Sellers in the place of products, line status in the place of the price.
SELLER_ROWS = """bag AS (
    SELECT o.o_custkey AS cust, o.o_orderkey AS ord, li.l_suppkey AS part
    FROM lineitem li JOIN orders o ON o.o_orderkey = li.l_orderkey),
merged AS (
    SELECT DISTINCT o.o_custkey AS cust, o.o_orderkey AS ord, li.l_suppkey AS part, li.l_linestatus AS price
    FROM lineitem li JOIN orders o ON o.o_orderkey = li.l_orderkey)"""
EVERY_SELLER = "seed AS (SELECT s_suppkey AS seed_id FROM supplier)"


def _sellers(body: str) -> str:
    body = body.replace("JOIN part pp ON pp.p_partkey = y.part", "JOIN supplier pp ON pp.s_suppkey = y.part")
    return f"WITH {EVERY_SELLER},\n{SELLER_ROWS},\n{body}\n{TOPK}"


ORDERS_LOGICAL = """SELECT o_orderkey AS order_id, o_custkey AS customer_id,
       o_orderstatus AS status, o_orderdate AS purchased_at FROM orders"""

ORACLE_SQL: dict[str, str] = {
    "also_bought_any": _rec(ONE_PRODUCT, ALSO_BOUGHT_ANY),
    "also_bought_different_order": _rec(ONE_PRODUCT, ALSO_BOUGHT_DIFFERENT),
    "also_bought_many": _rec(ALL_PRODUCTS, ALSO_BOUGHT_ANY),
    "bought_together": _rec(ONE_PRODUCT, BOUGHT_TOGETHER),
    "also_bought_all": _rec(EVERY_PRODUCT, ALSO_BOUGHT_ANY),
    "also_bought_different_order_all": _rec(EVERY_PRODUCT, ALSO_BOUGHT_DIFFERENT),
    "bought_together_all": _rec(EVERY_PRODUCT, BOUGHT_TOGETHER),
    "bought_together_many": _rec(ALL_PRODUCTS, BOUGHT_TOGETHER),
    "city_category_recs": _rec(ONE_CUSTOMER, CITY_CATEGORY),
    "city_category_recs_many": _rec(ALL_CUSTOMERS, CITY_CATEGORY),
    "own_products": _rec(ONE_CUSTOMER, OWN_PRODUCTS),
    "own_products_many": _rec(ALL_CUSTOMERS, OWN_PRODUCTS_MERGED),
    "neighbour_recs_d2": _rec(ONE_CUSTOMER, WALK_D2),
    "neighbour_recs_d3": _rec(ONE_CUSTOMER, WALK_D3),
    "neighbour_recs_d4": _rec(ONE_CUSTOMER, WALK_D4),
    "neighbour_recs_simple_d2": _rec(ONE_CUSTOMER, SIMPLE_D2),
    "neighbour_recs_simple_d3": _rec(ONE_CUSTOMER, SIMPLE_D3),
    "neighbour_recs_simple_d4": _rec(ONE_CUSTOMER, SIMPLE_D4),
    "neighbour_recs_many_d3": _rec(ALL_CUSTOMERS, WALK_D3_COUNTED),
    "neighbour_recs_simple_many_d3": _rec(ALL_CUSTOMERS, SIMPLE_D3_COUNTED),
    "neighbour_recs_active_d2": _rec(ACTIVE_CUSTOMERS, WALK_D2),
    "customer_hops": _hops_sql(4),
    "shortest_path_length": _path_length_sql(10),
    "customer_hops_same_city": _hops_sql(4, SAME_CITY_PAIRS),
    "shortest_path_same_city": _path_length_sql(10, SAME_CITY_PAIRS),
    "graph_vertices": """
SELECT 'customer' AS label, c_custkey AS vertex_id, CAST(c_nationkey AS VARCHAR) AS property FROM customer
UNION ALL SELECT 'seller', s_suppkey, CAST(s_nationkey AS VARCHAR) FROM supplier
UNION ALL SELECT 'product', p_partkey, p_brand FROM part
UNION ALL SELECT 'order', o_orderkey, CAST(NULL AS VARCHAR) FROM orders o
          WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)""",
    "edges_placed": """
SELECT o_custkey AS customer_id, o_orderkey AS order_id FROM orders o
WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)""",
    "edges_contains": "WITH " + RESOLVED_ITEMS + """
SELECT DISTINCT l_orderkey AS order_id, l_partkey AS product_id, l_extendedprice AS price FROM items""",
    "edges_sold_by": "WITH " + RESOLVED_ITEMS + """
SELECT DISTINCT l_partkey AS product_id, l_suppkey AS seller_id FROM items""",
    "unresolved_rows": """
WITH snap AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
known AS (SELECT o_orderkey FROM snap s WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = s.o_custkey))
SELECT 'orders' AS entity, o_orderkey AS order_id, o_custkey AS customer_id,
       CAST(NULL AS BIGINT) AS product_id, CAST(NULL AS BIGINT) AS seller_id, 'unknown customer' AS reason
FROM snap s WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = s.o_custkey)
UNION ALL
SELECT 'items', l_orderkey, CAST(NULL AS BIGINT), l_partkey, l_suppkey, 'unknown order'
FROM lineitem i WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.o_orderkey = i.l_orderkey)
UNION ALL
SELECT 'items', l_orderkey, CAST(NULL AS BIGINT), l_partkey, l_suppkey, 'unknown product'
FROM lineitem i WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = i.l_partkey)
UNION ALL
SELECT 'items', l_orderkey, CAST(NULL AS BIGINT), l_partkey, l_suppkey, 'unknown seller'
FROM lineitem i WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = i.l_suppkey)""",
    "unresolved_rows_partial": "WITH " + PARTIAL + """known AS (
    SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM some_customers c WHERE c.c_custkey = o.o_custkey)),
lost AS (
SELECT 'orders' AS entity, o_orderkey AS o, o_custkey AS c, CAST(NULL AS BIGINT) AS p, CAST(NULL AS BIGINT) AS s,
       'unknown customer' AS reason
FROM orders o WHERE NOT EXISTS (SELECT 1 FROM some_customers c WHERE c.c_custkey = o.o_custkey)
UNION ALL
SELECT 'items', l_orderkey, NULL, l_partkey, l_suppkey, 'unknown order'
FROM lineitem i WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.o_orderkey = i.l_orderkey)
UNION ALL
SELECT 'items', l_orderkey, NULL, l_partkey, l_suppkey, 'unknown product'
FROM lineitem i WHERE NOT EXISTS (SELECT 1 FROM some_parts p WHERE p.p_partkey = i.l_partkey)
UNION ALL
SELECT 'items', l_orderkey, NULL, l_partkey, l_suppkey, 'unknown seller'
FROM lineitem i WHERE NOT EXISTS (SELECT 1 FROM some_suppliers s WHERE s.s_suppkey = i.l_suppkey))
SELECT entity, CAST(o AS VARCHAR) AS order_id, CAST(c AS VARCHAR) AS customer_id, CAST(p AS VARCHAR) AS product_id,
       CAST(s AS VARCHAR) AS seller_id, reason FROM lost""",
    "edges_placed_partial": "WITH " + PARTIAL_ITEMS + " SELECT o_custkey AS customer_id, o_orderkey AS order_id FROM known_orders",
    "edges_contains_partial": "WITH " + PARTIAL_ITEMS + """
SELECT DISTINCT l_orderkey AS order_id, l_partkey AS product_id, l_extendedprice AS price FROM items""",
    "edges_sold_by_partial": "WITH " + PARTIAL_ITEMS + """
SELECT DISTINCT l_partkey AS product_id, l_suppkey AS seller_id FROM items""",
    "edges_contains_merged": """
SELECT DISTINCT l_orderkey AS order_id, l_suppkey AS product_id, l_linestatus AS price FROM lineitem""",
    "sellers_together": _sellers(BOUGHT_TOGETHER.replace("JOIN bag", "JOIN merged")),
    "sellers_also_bought": _sellers(ALSO_BOUGHT_DIFFERENT),
    "load_ignore_duplicates": """
WITH new AS (
    SELECT l_orderkey AS order_id, l_linenumber AS line_number, l_partkey AS product_id,
           l_suppkey AS seller_id, l_extendedprice AS price FROM lineitem),
firsts AS (
    SELECT DISTINCT ON (order_id, line_number) * FROM new
    ORDER BY order_id, line_number, product_id, seller_id, price),
existing AS (
    SELECT l_orderkey AS order_id, l_linenumber AS line_number
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE o_orderdate < TIMESTAMP '1996-01-01')
SELECT * FROM firsts f
WHERE NOT EXISTS (SELECT 1 FROM existing e
                  WHERE e.order_id = f.order_id AND e.line_number = f.line_number)""",
    "load_report": """
WITH counts AS (
    SELECT 'customers' AS table_name, COUNT(*) AS rows_read, COUNT(DISTINCT c_custkey) AS rows_kept FROM customer
    UNION ALL SELECT 'products', COUNT(*), COUNT(DISTINCT p_partkey) FROM part
    UNION ALL SELECT 'sellers', COUNT(*), COUNT(DISTINCT s_suppkey) FROM supplier
    UNION ALL SELECT 'orders', COUNT(*),
        (SELECT COUNT(DISTINCT o_orderkey) FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01')
        FROM orders
    UNION ALL SELECT 'items', COUNT(*), COUNT(*) FROM lineitem
    UNION ALL SELECT 'keyed items', COUNT(*),
        (SELECT COUNT(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) FROM lineitem)
SELECT table_name, CAST(rows_read AS BIGINT) AS rows_read, CAST(rows_kept AS BIGINT) AS rows_kept,
       CAST(rows_read - rows_kept AS BIGINT) AS rows_skipped, 'ok' AS status,
       CAST(NULL AS VARCHAR) AS error
FROM counts""",
    "stored_load": """
WITH counts AS (
    SELECT 'customers' AS table_name, COUNT(*) AS r, COUNT(*) FILTER (WHERE NOT coalesce(c_nationkey % 2 = 0, FALSE)) AS k FROM customer
    UNION ALL SELECT 'products', COUNT(*), COUNT(*) FROM part
    UNION ALL SELECT 'sellers', COUNT(*), COUNT(*) FROM supplier
    UNION ALL SELECT 'orders', COUNT(*), COUNT(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1997-01-01') FROM orders
    UNION ALL SELECT 'items', COUNT(*), COUNT(*) FROM lineitem)
SELECT table_name, CAST(r AS BIGINT) AS rows_read, CAST(k AS BIGINT) AS rows_kept, CAST(r - k AS BIGINT) AS rows_skipped,
       'ok' AS status, CAST(NULL AS VARCHAR) AS error FROM counts""",
    "stored_orders": """
SELECT o_orderkey AS order_id, o_custkey AS customer_id,
       CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'stored' ELSE o_orderstatus END AS status,
       o_orderdate AS purchased_at FROM orders""",
    "check_unique": """
SELECT l_orderkey AS order_id, l_linenumber AS line_number, COUNT(*) AS n
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""",
    "entities_csv_roundtrip": """
SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_partkey AS VARCHAR) AS product_id,
       CAST(l_suppkey AS VARCHAR) AS seller_id, l_extendedprice AS price FROM lineitem""",
    "snapshot_overwrite": ORDERS_LOGICAL,
    "incremental_load": """
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
       o_orderstatus AS status, o_orderdate AS purchased_at FROM orders""",
    "active_customers": "WITH " + CUSTOMER_POOL + " SELECT customer_id, n_items FROM customer_pool",
    "popular_products": "WITH " + PRODUCT_POOL + " SELECT product_id, n_orders FROM product_pool",
    "draw_seeds": "WITH " + CUSTOMER_POOL + """
SELECT customer_id, n_items FROM customer_pool
ORDER BY md5(CAST(customer_id AS VARCHAR) || ':42'), customer_id LIMIT 5""",
    "seed_pairs": "WITH " + PAIRS + " SELECT source_id, target_id FROM pairs",
    "active_customers_over_60": """
SELECT o.o_custkey AS customer_id, CAST(COUNT(i.l_partkey) AS BIGINT) AS n_items
FROM orders o JOIN lineitem i ON o.o_orderkey = i.l_orderkey
GROUP BY o.o_custkey HAVING COUNT(i.l_partkey) > 60""",
    "popular_products_over_40": """
SELECT l_partkey AS product_id, CAST(COUNT(l_orderkey) AS BIGINT) AS n_orders
FROM lineitem GROUP BY l_partkey HAVING COUNT(l_orderkey) > 40""",
    "seeds_with_fallback": "WITH " + CUSTOMER_POOL + " SELECT customer_id FROM customer_pool",
    "seeds_from_fallback": """
WITH pool AS (
    SELECT o.o_custkey AS customer_id FROM orders o JOIN lineitem i ON o.o_orderkey = i.l_orderkey
    GROUP BY o.o_custkey HAVING COUNT(i.l_partkey) > 75)
SELECT customer_id FROM pool WHERE (SELECT COUNT(*) FROM pool) >= 2
UNION ALL SELECT CAST(id AS BIGINT) FROM (VALUES (1), (2), (3)) AS fixed(id) WHERE (SELECT COUNT(*) FROM pool) < 2""",
    "timed_runs": "WITH " + RUNS + """
SELECT engine, query, iteration, elapsed_ms, failed FROM flagged WHERE NOT warm""",
    "run_summary": "WITH " + SUMMARY + " SELECT * FROM summary",
    "results_csv": "WITH " + SUMMARY + " SELECT * FROM summary",
    "compare_runs": "WITH " + SUMMARY + """
SELECT query,
       MAX(mean_ms) FILTER (WHERE engine = 'view') AS view_mean_ms,
       MAX(mean_ms) FILTER (WHERE engine = 'click') AS click_mean_ms,
       ROUND(MAX(mean_ms) FILTER (WHERE engine = 'click')
             / MAX(mean_ms) FILTER (WHERE engine = 'view'), 6) AS click_vs_view,
       MAX(mean_ms) FILTER (WHERE engine = 'error') AS error_mean_ms,
       ROUND(MAX(mean_ms) FILTER (WHERE engine = 'error')
             / MAX(mean_ms) FILTER (WHERE engine = 'view'), 6) AS error_vs_view,
       MAX(mean_ms) FILTER (WHERE engine = 'purchase') AS purchase_mean_ms,
       ROUND(MAX(mean_ms) FILTER (WHERE engine = 'purchase')
             / MAX(mean_ms) FILTER (WHERE engine = 'view'), 6) AS purchase_vs_view,
       MAX(mean_ms) FILTER (WHERE engine = 'signup') AS signup_mean_ms,
       ROUND(MAX(mean_ms) FILTER (WHERE engine = 'signup')
             / MAX(mean_ms) FILTER (WHERE engine = 'view'), 6) AS signup_vs_view
FROM summary GROUP BY query""",
}
