"""Spark session settings and the shared scratch folder.

The library never invents a machine-local folder: intermediate tables (loop state,
round trips) go under the folder the cluster names in ``spark.checkpoint.dir``.
Only when that setting is missing (local tests, the bench) is a folder chosen here.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Settings that matter at scale, all public Spark configuration keys.
SCALE_CONF = {
    # Adaptive execution: runtime re-planning with measured stage sizes, broadcast
    # conversion from real sizes, partition coalescing and skewed-partition splitting.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # Runtime bloom filters let a selective side prune the scan of a big side.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # No web server.
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "basketgraph",
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(SCALE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Ids and counts shrink about tenfold in a shuffle, so Spark's 64 MB of it fill a task with a
# gigabyte of hash table. The first number is merged down to partitions of the second.
FINE_SHUFFLES = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "400",
                 "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m"}


def fine_shuffles(spark: SparkSession) -> None:
    """Smaller shuffle partitions, where the session keeps Spark's defaults."""
    for key, value in FINE_SHUFFLES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


# A join whose one side has only small partitions (compressed) hashes them and sorts neither side.
HASHED_JOINS = {"spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "16m"}


def hashed_joins(spark: SparkSession) -> None:
    """Where the session keeps Spark's default, which always sorts."""
    for key, value in HASHED_JOINS.items():
        if spark.conf.get(key) in (None, "0", "0b"):
            spark.conf.set(key, value)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows, for rows that hold whole lists. A size that the user has
    set stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's default
        spark.conf.set(key, str(rows))


def checkpoint_root(spark: SparkSession) -> str | None:
    """The shared folder named by the cluster, or None when unset."""
    value = spark.conf.get(CHECKPOINT_KEY, None)
    if not value:
        value = spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if not value:
        value = spark.sparkContext.getCheckpointDir()
    return value or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder. A local session without one (tests, the bench) gets a temporary
    folder; on a cluster a missing setting is an error, raised only by operators that
    write intermediate tables."""
    root = checkpoint_root(spark)
    if root is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="basketgraph-ckpt-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never-reused location under the shared folder."""
    root = ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/basketgraph/{label}-{uuid.uuid4().hex}"
