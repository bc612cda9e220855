"""Session settings for large runs.

Sizes follow from the input, not from a fixed number: shuffle partitions of
about 128 MB, scans of 256 MB, and adaptive execution to merge what turns out
small and to split what turns out skewed.
"""

from __future__ import annotations

PARTITION_MB = 128
SCAN_MB = 256


def large_run_conf(shuffle_tb: float, total_cores: int) -> dict[str, str]:
    """Settings for a run that shuffles about `shuffle_tb` terabytes on `total_cores` cores."""
    by_size = int(shuffle_tb * 1024 * 1024 / PARTITION_MB)
    partitions = max(by_size, 2 * total_cores)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{PARTITION_MB}m",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": f"{2 * PARTITION_MB}m",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": f"{SCAN_MB}m",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }


def apply(builder, conf: dict[str, str]):
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder
