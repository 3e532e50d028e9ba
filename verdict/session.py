"""Session construction and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that matter at scale. AQE re-plans joins at runtime from real sizes
# (broadcast only under the threshold, sort-merge beyond it), coalesces small
# shuffle partitions and splits skewed ones.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # Shuffle partitions are sized by bytes, not count: AQE merges small ones
    # and splits skewed ones toward this size.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Call-site capture on every PySpark call is debugging metadata; it costs
    # driver round trips while a plan is being built.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Generated classes are cached by code; a session that serves many
    # different queries would otherwise evict and recompile them.
    "spark.sql.codegen.cache.maxEntries": "2000",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "verdict", extra: dict | None = None) -> SparkSession:
    """A session with the scale settings. On a cluster pass no master."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shuffle_partitions_for(shuffle_bytes: int, cores: int,
                           target_bytes: int = 256 * 1024 * 1024) -> int:
    """Initial ``spark.sql.shuffle.partitions`` for a job expected to shuffle
    ``shuffle_bytes``: enough partitions that each holds about
    ``target_bytes`` (so a task's share fits in executor memory without
    spilling much), and at least two waves of the cluster's cores. AQE then
    merges the small ones and splits skewed ones at run time.

    For the scoring path at 100 TB of replies (narrow rows after parsing, about
    5 TB shuffled before the map-side aggregate), that is about 20,000."""
    return max(2 * cores, -(-shuffle_bytes // target_bytes))


def parallelism(spark: SparkSession) -> int:
    """Task slots of the cluster (classic sessions), else the configured
    default parallelism, else the local core count."""
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001 - e.g. a Spark Connect session
        conf = spark.conf.get("spark.default.parallelism", None)
        return int(conf) if conf else (os.cpu_count() or 8)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set (a shared file system or object store). Only
    a local-mode session without it gets a private folder, as in tests.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "") or ""
    if master != "local" and not master.startswith("local["):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    path = tempfile.mkdtemp(prefix="verdict-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    try:
        spark.sparkContext.setCheckpointDir(path)
    except Exception:  # noqa: BLE001 - no SparkContext on this client
        pass
    return path


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh, unique folder under the shared checkpoint root; Spark makes it
    on its file system when something is written."""
    root = checkpoint_root(spark)
    return f"{root}/verdict/{label}-{uuid.uuid4().hex[:12]}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def files_cleared(spark: SparkSession) -> Iterator[None]:
    """Queries run inside remove their shuffle files as they end; else the
    files lie there until the driver collects its garbage. A frame that is run
    twice makes its shuffles twice."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
