"""Spark session defaults for batch and streaming jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that matter on a cluster as much as on one machine: adaptive
#: planning (runtime broadcast, partition coalescing, skew-join splitting) and a
#: fixed UTC zone so time buckets do not depend on the host.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # stream state outside the heap; keyed detector state needs it
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # recording a call site for every column expression makes plan building several times slower
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "plantpulse", master: str | None = None, **extra: str) -> SparkSession:
    """Create (or fetch) a session carrying :data:`SETTINGS`.

    ``master`` is left to spark-submit unless given.  Extra settings use
    double underscores for dots: ``spark__sql__shuffle__partitions="8"``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; ``fallback`` only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return folder
