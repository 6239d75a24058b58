"""Session settings for large runs, and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Sizes keep a task's input and a shuffle partition near 256 MB; AQE merges small
# partitions and splits skewed join partitions at run time. Arrow batches are bounded by
# bytes, as payloads vary a lot in size.
LARGE_RUN_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}


PARTITION_BYTES = 512 * 1024 * 1024


def shuffle_partitions(input_bytes: int) -> int:
    """Number of shuffle partitions for an input of that size.

    Half a gigabyte each, so that a task's sort stays in memory; at least Spark's default of
    200. It grows with the input without a bound.
    """
    return max(200, -(-input_bytes // PARTITION_BYTES))


def with_large_run_conf(builder, input_bytes: int | None = None):
    """Apply the settings above, and partitions for ``input_bytes``, to a session builder."""
    for key, value in LARGE_RUN_CONF.items():
        builder = builder.config(key, value)
    if input_bytes is not None:
        builder = builder.config(
            "spark.sql.shuffle.partitions", str(shuffle_partitions(input_bytes)))
    return builder


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder path under the cluster's shared ``spark.checkpoint.dir``.

    Where that is unset, the folder lies below the warehouse, which executors share too.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
