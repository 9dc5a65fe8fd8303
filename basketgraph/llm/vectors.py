"""Shared steps of the embedding operators: valid vectors, classes of equal vectors, and
walking sorted groups of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lengths(classes: DataFrame, column: str = "v") -> list[tuple[int, int]]:
    """(length, vectors) of every vector length in the table, the shortest first."""
    return [(r["n"], r["count"]) for r in classes.groupBy(F.size(column).alias("n")).count().orderBy("n").collect()]


def valid(column: str = "embedding") -> Column:
    """Without null or non-finite components, not all zero."""
    return F.coalesce(F.expr(
        f"size({column}) > 0 and forall({column}, x -> x is not null and not isnan(x) "
        f"and abs(x) < double('Infinity')) and exists({column}, x -> x <> 0)"), F.lit(False))


def vector_key(column: str = "embedding") -> Column:
    return F.xxhash64(F.transform(F.col(column), lambda x: x + F.lit(0.0)))  # -0.0 counts as 0.0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), dim)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str],
            work: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None],
            most_rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Calls ``work(table, starts)`` on runs of whole groups; ``batches`` are sorted by
    ``keys``. A group that crosses batches is held back until it is complete, so memory is
    a batch and one group."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def starts_of(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows, bool)
        change[0] = True
        for k in keys:
            column = table.column(k).to_numpy()
            change[1:] |= column[1:] != column[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < most_rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = starts_of(table)
        whole = int(starts[-1])
        if whole:
            out = work(table.slice(0, whole), starts[:-1])
            if out is not None:
                yield out
        held = table.slice(whole).to_batches()
        rows = table.num_rows - whole
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        if table.num_rows:
            out = work(table, starts_of(table))
            if out is not None:
                yield out
