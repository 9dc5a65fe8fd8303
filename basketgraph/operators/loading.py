"""A2-A4: loading with skipped conflicts, the load report, and key uniqueness checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fine_shuffles


def first_per_key(df: DataFrame, keys: list[str], order_by: str | None = None) -> DataFrame:
    """One row per key: the one with the smallest ``order_by`` (the first submitted; a NULL
    order comes last, ties take the smallest row), or, without an order, the smallest row.
    Rows with a NULL in their key equal no other row, as under a unique constraint, and are
    all kept. An aggregation with map-side combining, so a key repeated a billion times never
    lands whole in one task."""
    others = [c for c in df.columns if c not in keys]
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    keyed, unkeyed = df.where(whole), df.where(~whole)
    if not others:
        return keyed.select(*keys).distinct().unionByName(unkeyed.select(*keys))
    first = [F.col(order_by).isNull().alias("_no_order"), F.col(order_by).alias("_order")] if order_by else []
    row = F.struct(*first, F.struct(*[F.col(c) for c in others]).alias("_row"))
    return (keyed.groupBy(*keys).agg(F.min(row)["_row"].alias("_row")).select(*keys, "_row.*")
            .unionByName(unkeyed.select(*keys, *others)))


def load_ignore_duplicates(new: DataFrame, existing: DataFrame | None, keys: list[str],
                           order_by: str | None = None) -> DataFrame:
    """A2: the rows an ``INSERT ... ON CONFLICT DO NOTHING`` would add.

    Within the batch the first row per key wins; rows whose key is already stored are
    skipped. Without keys (a bag such as the items table) every row is kept.
    """
    if not keys:
        return new
    if order_by and order_by not in new.columns:
        raise ValueError(f"unknown order column {order_by!r}")
    kept = first_per_key(new, keys, order_by)
    if existing is not None:
        kept = kept.join(existing.select(*keys), keys, "left_anti")
    if order_by:
        kept = kept.drop(order_by)
    return kept


def load_report(loads: dict[str, tuple[DataFrame, DataFrame]],
                failed: dict[str, str] | None = None) -> DataFrame:
    """A3: (table_name, rows_read, rows_kept, rows_skipped, status, error) for every table.

    ``loads`` maps a table name to (rows submitted, rows kept); all counts come from one
    aggregation over the union, one job for every table; a table without rows is listed with
    zeros. ``failed`` maps a table name to its error text.
    """
    spark = None
    parts = []
    for name, (read, kept) in loads.items():
        spark = read.sparkSession
        parts.append(read.select(F.lit(name).alias("table_name"), F.lit(1).alias("r"),
                                 F.lit(0).alias("k")))
        parts.append(kept.select(F.lit(name).alias("table_name"), F.lit(0).alias("r"),
                                 F.lit(1).alias("k")))
    failed = failed or {}
    if spark is None:
        raise ValueError("load_report needs at least one loaded table")
    fine_shuffles(spark)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    names = spark.createDataFrame([(t,) for t in loads], "table_name string")
    counted = rows.groupBy("table_name").agg(F.sum("r").alias("r"), F.sum("k").alias("k"))
    counts = (names.join(counted, "table_name", "left")
              .select("table_name", F.coalesce("r", F.lit(0)).cast("long").alias("rows_read"),
                      F.coalesce("k", F.lit(0)).cast("long").alias("rows_kept"))
              .withColumn("rows_skipped", F.col("rows_read") - F.col("rows_kept"))
              .withColumn("status", F.lit("ok"))
              .withColumn("error", F.lit(None).cast("string")))
    if failed:
        bad = spark.createDataFrame(
            [(t, None, None, None, "failed", e) for t, e in failed.items()],
            "table_name string, rows_read long, rows_kept long, rows_skipped long, status string, "
            "error string")
        counts = counts.unionByName(bad)
    return counts


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """A4: every key value held by more than one row, with its row count ``n``."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
              .where(F.col("n") > 1))


def require_unique(df: DataFrame, keys: list[str]) -> None:
    """A4, strict: raise when any key value repeats."""
    dup = check_unique(df, keys).limit(1).count()
    if dup:
        raise ValueError(f"key {keys} is not unique")


def load_entities(spark, root: str, layout: dict | None = None, fmt: str = "csv",
                  stored: dict[str, DataFrame] | None = None,
                  order_by: dict[str, str] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The load run: every entity in foreign-key order (dimensions first, items last) is
    read (A1), loses its rows whose key is already stored or repeats within the file (A2),
    and is reported (A3). A table that fails (missing file, unreadable columns) is
    reported as failed and the run goes on, as the original loader did.

    Returns the rows to add per table and the report; ``raise_if_failed`` turns failures
    into an error for a non-zero exit.
    """
    from ..layout import ENTITIES, KEYS
    from ..sources.entities import read_entity

    stored = stored or {}
    order_by = order_by or {}
    kept: dict[str, DataFrame] = {}
    loads: dict[str, tuple[DataFrame, DataFrame]] = {}
    failed: dict[str, str] = {}
    for entity in ENTITIES:
        try:
            new = read_entity(spark, root, entity, layout, fmt)
            _read_through(new)  # every column of every row, so a bad value fails here
            rows = load_ignore_duplicates(new, stored.get(entity), KEYS[entity],
                                          order_by.get(entity))
        except Exception as exc:  # noqa: BLE001 - every failure is reported per table
            failed[entity] = str(exc)
            continue
        kept[entity] = rows
        loads[entity] = (new, rows)
    if not loads:
        report = spark.createDataFrame(
            [(t, None, None, None, "failed", e) for t, e in failed.items()],
            "table_name string, rows_read long, rows_kept long, rows_skipped long, "
            "status string, error string")
    else:
        report = load_report(loads, failed)
    return kept, report


REPORT = ("table_name string, rows_read long, rows_kept long, rows_skipped long, status string, "
          "error string")


def store_entities(spark, root: str, target: str, layout: dict | None = None, fmt: str = "csv",
                   order_by: dict[str, str] | None = None, buckets: int = 64) -> DataFrame:
    """The load run that stores (A1, A2, A3): each entity in foreign-key order is read, and the
    rows whose key is new are added to the stored table ``target/<entity>``, whole or not at
    all. A table that fails is reported and left as it was, and the run goes on.

    Returns the report: rows submitted, kept and skipped, as counted by the read and the write.
    """
    from ..layout import ENTITIES, KEYS
    from ..sources.entities import read_entity
    from ..sources.stored import StoredTable

    report = []
    for entity in ENTITIES:
        try:
            new = read_entity(spark, root, entity, layout, fmt)
            submitted = _read_through(new)
            added = StoredTable(spark, f"{target}/{entity}", KEYS[entity], buckets).add_new(new, (order_by or {}).get(entity))
            report.append((entity, submitted, added, submitted - added, "ok", None))
        except Exception as exc:  # noqa: BLE001 - every failure is reported per table
            report.append((entity, None, None, None, "failed", str(exc)))
    return spark.createDataFrame(report, REPORT)


def _read_through(df: DataFrame) -> int:
    """Rows, counted by a job that evaluates every column, with its casts, of every row."""
    return df.select(F.xxhash64(*df.columns).alias("h")).agg(F.max("h"), F.count(F.lit(1)).alias("n")).first()["n"]


def raise_if_failed(report: DataFrame) -> None:
    """Raise when any table of a load report failed (the loader's non-zero exit)."""
    bad = [r.table_name for r in report.where(F.col("status") == "failed")
           .select("table_name").collect()]
    if bad:
        raise RuntimeError(f"load failed for tables: {', '.join(sorted(bad))}")
