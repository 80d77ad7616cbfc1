"""Session construction and the shared scratch location.

The library never invents a machine-local scratch folder on a cluster: work
that must cut lineage or keep streaming state goes under the folder the
cluster names in ``spark.checkpoint.dir``.  Only a local-mode session (tests,
bench) without that setting gets one created under the system temp dir.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings we rely on.  ANSI stays on (Spark 4 default) so decimal overflow
# raises instead of silently producing NULL; UTC keeps date derivation stable.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoint files go once nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Streaming state (one stock figure per product) kept in RocksDB, off-heap,
    # so millions of keys do not sit on the executor heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


# Sizing for a large cluster (1000 executors, ~100 TB of Parquet): scan splits
# of 512 MB, shuffle partitions sized by AQE towards 256 MB each from a high
# starting count, skewed partitions split at 5× the median, and Spark's own
# size check (plan statistics, then measured shuffle sizes) for broadcasts.
CLUSTER_CONF = {
    "spark.sql.files.maxPartitionBytes": str(512 * 1024 * 1024),
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def session_conf(master: str, shuffle_partitions: int | None = None, extra: dict | None = None) -> dict:
    """Settings of a session: a cluster gets CLUSTER_CONF, a local master few partitions."""
    conf = dict(DEFAULT_CONF)
    if master.startswith("local") and not master.startswith("local-cluster"):
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    else:
        conf.update(CLUSTER_CONF)
        if shuffle_partitions:
            conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return {**conf, **(extra or {})}


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None,
                  app_name: str = "stockroom", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = session_conf(master, shuffle_partitions, extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, creating one only for local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS) before running jobs that checkpoint or stream")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="stockroom-ckpt-"))
    return sc.getCheckpointDir()


def checkpoint_dir(spark: SparkSession) -> str:
    return ensure_checkpoint_dir(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint location."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/stockroom/{name}-{uuid.uuid4().hex[:12]}"


__all__ = ["build_session", "session_conf", "ensure_checkpoint_dir", "checkpoint_dir", "scratch_path",
           "DEFAULT_CONF", "CLUSTER_CONF"]
