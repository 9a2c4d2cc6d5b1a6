"""Session construction and the shared output folder.

Jobs that must survive executor loss cut lineage by writing into the shared
folder the cluster names in ``spark.checkpoint.dir``.  That setting is read from
the session; a private folder is only created for local-mode sessions (tests,
bench) where it is unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(
    cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "fanlens", java_options: str | None = None
) -> SparkSession:
    """Local session for tests and the bench (a cluster session comes from the caller)."""
    builder = SparkSession.builder
    if java_options:
        builder = builder.config("spark.driver.extraJavaOptions", java_options)
    spark = (
        builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # joins on (uid, x) may reuse a uid hash partitioning instead of re-shuffling
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        # AQE may replace a sort-merge join by a shuffled hash join when every build-side
        # partition is measured below this size (no sort of the large side)
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a private one only in local mode."""
    current = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="fanlens-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir() or path


def shared_path(spark: SparkSession, *parts: str, unique: bool = False) -> str:
    """A path below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    tail = list(parts)
    if unique:
        tail.append(uuid.uuid4().hex[:12])
    return os.path.join(base, "fanlens", *tail)
