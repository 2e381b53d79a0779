"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Settings the operators rely on. Sizes (shuffle partitions, memory) stay with the cluster.
REQUIRED_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Older kinds of stored times have no statistics, so lookups by time would skip no file.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}

# Only streams with per-key state functions need this one; it is harmless elsewhere.
STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators need to a running session."""
    for key, value in REQUIRED_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder that every executor sees: below ``spark.checkpoint.dir``, or the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/palaver/{purpose}-{uuid.uuid4().hex}"
