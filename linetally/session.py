"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app_name: str = "linetally", master: str | None = None, **conf: str) -> SparkSession:
    """Start (or reuse) a session with UTC timestamps and adaptive execution.

    Partition counts are left to adaptive execution: start with many shuffle
    partitions on a cluster and let it coalesce the small ones. Pass any other
    setting as a keyword with dots written as double underscores.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
