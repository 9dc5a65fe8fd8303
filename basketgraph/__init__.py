"""basketgraph: product recommendation and relationship analytics on Spark DataFrames."""

from .operators.graph import (build_contains_edges, build_placed_edges, build_sold_by_edges,
                              build_vertices, unresolved_rows, vertex_table)
from .operators.loading import (check_unique, load_entities, load_ignore_duplicates,
                                load_report, raise_if_failed, require_unique)
from .operators.paths import neighbour_recs, neighbour_recs_batched, path_counts
from .operators.reach import customer_hops, pair_distances, shortest_path_length
from .operators.recommend import (bought_together, city_category_recs, customers_also_bought,
                                  own_products)
from .operators.runs import compare_runs, drop_warmup, run_summary
from .operators.seeds import (active_customers, draw_seeds, popular_products, seed_pairs,
                              with_fallback)
from .session import build_session
from .sources.entities import read_entities, read_entity
from .sources.sinks import write_results, write_snapshot
from .store import OrderStore

__all__ = [
    "OrderStore", "build_session",
    "read_entity", "read_entities", "write_snapshot", "write_results",
    "load_ignore_duplicates", "load_report", "load_entities", "raise_if_failed",
    "check_unique", "require_unique",
    "build_vertices", "vertex_table", "build_placed_edges", "build_contains_edges",
    "build_sold_by_edges", "unresolved_rows",
    "active_customers", "popular_products", "draw_seeds", "seed_pairs", "with_fallback",
    "customers_also_bought", "bought_together", "city_category_recs", "own_products",
    "neighbour_recs", "neighbour_recs_batched", "path_counts",
    "customer_hops", "shortest_path_length", "pair_distances",
    "drop_warmup", "run_summary", "compare_runs",
]
