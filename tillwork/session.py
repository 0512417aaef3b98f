"""A SparkSession with the settings the library is tuned and tested with."""

from __future__ import annotations

from pyspark.sql import SparkSession

# State of streams on local disk with a log in the checkpoint, not in the heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"


def build_session(
    app: str = "tillwork",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **extra: str,
) -> SparkSession:
    """Build (or get) a session.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: spark-submit
    names the master, and adaptive execution coalesces a generous initial
    partition count to what each stage turns out to need.
    """
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # A join key that holds a large part of the fact table is split at run time.
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        STATE_STORE_SETTING: STATE_STORE,
    }
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    else:
        conf["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = "4000"
    conf.update(extra)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
