"""A stored table that loads add to or replace as a whole or not at all.

Every load writes its rows into a folder of its own under ``data/``. Then one single-file
manifest, ``manifest/version=<n>``, names the folders the table consists of; readers take the
highest version. A load that fails before its manifest is written leaves the former table as it
was, and its folder is never read. One writer at a time is assumed: a version that is already
there fails the second writer's load.

A keyed table is dealt into hash buckets of its key, each a folder, with Parquet Bloom filters on
the key columns. A load of few rows collects the buckets it can hit (at most ``buckets`` numbers)
and reads only those; of few keys (``functions.lookup``) it also pushes the keys themselves, which
the Bloom filters answer. So what a small load reads of the stored keys follows the load.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.lookup import any_of, lookup_keys

BUCKET = "_bucket"


class StoredTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str] | None = None, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self.keys, self.buckets = list(keys or []), buckets if keys else 1

    # -- versions ---------------------------------------------------------------------------

    def version(self) -> tuple[int, list[str]]:
        """The newest version and the folders it consists of; (0, []) before the first load."""
        try:
            manifests = self.spark.read.parquet(f"{self.path}/manifest")
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return 0, []
        newest = manifests.orderBy(F.desc("version")).first()  # one row a load
        return (int(newest["version"]), list(newest["folders"])) if newest else (0, [])

    def _commit(self, version: int, folders: list[str]) -> None:
        manifest = self.spark.createDataFrame([(folders,)], "folders array<string>").coalesce(1)
        manifest.write.mode("errorifexists").parquet(f"{self.path}/manifest/version={version}")

    # -- reading ----------------------------------------------------------------------------

    def read(self, columns: bool = True) -> DataFrame | None:
        """The rows of the newest version; None before the first load."""
        _, folders = self.version()
        if not folders:
            return None
        table = self.spark.read.option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/{f}" for f in folders])
        return table.drop(BUCKET, "load") if columns else table

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int") if self.keys else F.lit(0)

    def may_hold(self, new: DataFrame) -> DataFrame | None:
        """Stored keys that rows of ``new`` can meet: those of its buckets, and if it has few
        keys only rows with such a key."""
        stored = self.read(columns=False)
        if stored is None:
            return None
        hit = [r[0] for r in new.select(self.bucket().alias("b")).distinct().collect()]  # at most ``buckets``
        stored = stored.where(F.col(BUCKET).isin(hit)) if hit else stored.where("false")
        most = lookup_keys(self.spark)
        if len(self.keys) == 1 and len(hit) <= most:
            key = self.keys[0]
            few = [r[0] for r in new.select(key).where(F.col(key).isNotNull()).distinct().limit(most + 1).collect()]
            if len(few) <= most:
                stored = stored.where(any_of(key, few))
        return stored.select(*self.keys)

    # -- writing ----------------------------------------------------------------------------

    def _stage(self, rows: DataFrame) -> tuple[str, int]:
        load = f"load={uuid.uuid4().hex}"
        seen = Observation(f"stored-{load[5:13]}")
        out = rows.withColumn(BUCKET, self.bucket())
        if self.keys:
            out = out.repartition(self.buckets, BUCKET)
        writer = out.observe(seen, F.count(F.lit(1)).alias("rows")).write.partitionBy(BUCKET)
        for key in self.keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
        writer.parquet(f"{self.path}/data/{load}")
        return load, seen.get["rows"]

    def replace(self, rows: DataFrame) -> int:
        """A10: the table becomes ``rows``. Returns their number."""
        version, _ = self.version()
        load, n = self._stage(rows)
        self._commit(version + 1, [load])
        return n

    def append(self, rows: DataFrame) -> int:
        """``rows`` are added. Returns their number."""
        version, folders = self.version()
        load, n = self._stage(rows)
        self._commit(version + 1, [*folders, load])
        return n

    def add_new(self, new: DataFrame, order_by: str | None = None) -> int:
        """A2: the rows of ``new`` whose key is neither stored nor repeated are added; of
        repeated keys the first. Returns how many were."""
        from ..operators.loading import load_ignore_duplicates

        stored = self.may_hold(new) if self.keys else None
        return self.append(load_ignore_duplicates(new, stored, self.keys, order_by))
