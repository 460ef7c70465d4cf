"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC wall clock for the few places that leave
# TIMESTAMP_NTZ (streaming watermarks), AQE for runtime re-planning (skewed
# joins, partition coalescing, broadcast conversion from real sizes).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # reliable checkpoints (validated batches, id allocation, training input)
    # are removed once their DataFrame is no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, app: str = "tessera",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; where it is unset, a local
    master gets a fresh scratch folder and any other an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tessera-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scale_conf(input_bytes: int, total_cores: int, shuffle_fraction: float = 0.1,
               target_partition_bytes: int = 128 << 20) -> dict:
    """Settings for a run over ``input_bytes`` of parquet on ``total_cores``.

    Scan splits and post-shuffle partitions aim at ``target_partition_bytes``
    (fits comfortably in an executor core's share of memory). Shuffled bytes
    are estimated as ``shuffle_fraction`` of the input: the reports prune
    columns and time ranges at the scan and aggregate map-side, so they
    shuffle a small share of what they read. AQE starts from that many
    partitions and coalesces small ones; a partition over 4x the target (and
    5x the median) is treated as skewed and split.
    """
    import math

    shuffle_bytes = max(1, int(input_bytes * shuffle_fraction))
    parts = max(2 * total_cores, math.ceil(shuffle_bytes / target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    }
