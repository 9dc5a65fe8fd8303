"""Loop state in the shared folder, size-checked broadcasts and connected components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import pin_metrics

MAX_BROADCAST_BYTES = 64 << 20


def kept(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``df`` written under ``spark.checkpoint.dir`` and read back, with its row count
    (``rows``) and further aggregates measured in the same job."""
    return pin_metrics(df, f"llm-{label}", **metrics)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``kept`` has written, once nothing reads them any more."""
    for table in tables:
        session = table.sparkSession
        files = table.inputFiles()
        if files:
            folder = session._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its measured rows fit in MAX_BROADCAST_BYTES;
    otherwise unchanged, and the join stays a shuffle join that AQE may split."""
    return F.broadcast(df) if rows * row_bytes <= MAX_BROADCAST_BYTES else df


def small_batches(spark, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows for tasks that read whole texts, so that a batch is a
    few megabytes in the JVM and again in Python. A size that the user has set stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's default
        spark.conf.set(key, str(rows))


def tucked(docs: DataFrame, *core: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with its other columns in one struct, where their names clash with nothing,
    and a function that brings back the columns in their order, ``added`` ones after them."""
    others = [c for c in docs.columns if c not in core]
    plain = docs.select(*[c for c in docs.columns if c in core], *(
        [F.struct(*[F.col(f"`{c}`") for c in others]).alias("other_columns")] if others else []))

    def restored(df: DataFrame, *added: str) -> DataFrame:
        return df.select(*[F.col(c) if c in core else F.col("other_columns")[c].alias(c) for c in docs.columns], *added)

    return plain, restored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node
    that links reach.

    Alternating large-star and small-star contraction (Kiveris et al., 2014): each round
    hangs every neighbour of a node on the smallest one, and the number of rounds grows
    with the logarithm of the longest path. Each round's edges are a table in the shared
    folder, so a lost executor costs a re-read. Nothing is collected but a checksum.
    """
    def hang(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return pairs.join(least, "a")

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        return (hang(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                .where("a <> b"))

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        hung = hang(down)
        return (hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                .union(hung.select("a", F.col("m").alias("b"))).where("a <> b").distinct())

    checksum = dict(total=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    state, seen = kept(edges.select("a", "b").where("a <> b").distinct(), "edges", **checksum)
    for _ in range(most_rounds):
        if not seen["rows"]:
            break
        after, now = kept(small_star(large_star(state)), "edges", **checksum)
        done = now == seen
        state, seen = after, now
        if done:
            break
    else:
        raise RuntimeError("components did not converge")
    roots = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
