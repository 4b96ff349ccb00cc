"""Session builder with the settings the operators are designed for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(app: str = "termweave", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session. ``conf`` keys use ``__`` for dots.

    On a cluster leave ``master`` unset and submit normally; shuffle partitions, memory and
    ``spark.checkpoint.dir`` then come from the cluster's own configuration.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def local_session(cpus: int | None = None, app: str = "termweave-local") -> SparkSession:
    """Single-JVM session for tests and the local benchmark."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return get_session(
        app,
        f"local[{n}]",
        spark__sql__shuffle__partitions=n,
        spark__driver__memory=os.environ.get("TERMWEAVE_DRIVER_MEMORY", "12g"),
        spark__ui__enabled="false",
    )
