"""Where intermediate tables live: the folder that the cluster names for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a session of this machine without one (tests) gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    known = getattr(shared_folder, "own", None)
    if known is None:
        known = shared_folder.own = tempfile.mkdtemp(prefix="run-")
    return known


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once as Parquet and read back: a cut of the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written_and_released(df: DataFrame, name: str) -> DataFrame:
    """``written``, after which the shuffle files that made the table are deleted at once.

    They would otherwise stay until the driver happens to collect its garbage. The session's
    setting is put back; the table is the recovery point.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP)
    conf.set(_CLEANUP, "true")
    try:
        return written(df, name)
    finally:
        conf.set(_CLEANUP, before)
