"""Session construction and the shared scratch folder.

On a cluster the session already exists and carries its own settings; ``get_session`` only fills in
defaults that are unset, so cluster configuration always wins.  Scratch output (lineage cuts, stream
checkpoints, staged tables) goes under ``spark.checkpoint.dir``, which on a cluster names a shared
folder.  Only when it is unset (local tests) do we create one.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Defaults for a fresh session.  AQE re-plans joins at runtime (broadcast only when the measured side is
# under the threshold, skew splitting for hot keys, partition coalescing after shuffles).
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "papyra") -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        _ensure_defaults(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("PAPYRA_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    _ensure_defaults(spark)
    return spark


def _ensure_defaults(spark: SparkSession) -> None:
    # Runtime-settable SQL options only; never override what the cluster set.
    if not spark.sparkContext.getConf().contains("spark.sql.session.timeZone"):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    # File-status listing of many known paths (a stream micro-batch, a landing folder) runs as a Spark job
    # with up to this many tasks; match it to the task slots instead of Spark's fixed 10000.
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    if spark.conf.get(key, "10000") == "10000":
        slots = spark.sparkContext.defaultParallelism
        spark.conf.set(key, str(min(10000, max(16, 2 * slots))))
    checkpoint_dir(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared scratch folder.  Read from the session; created locally only when unset (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a shared folder "
                               "(object store or HDFS); papyra never falls back to a machine-local folder there")
        d = tempfile.mkdtemp(prefix="papyra-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared scratch folder (never a machine-local temp dir on a cluster)."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
