"""Where intermediate tables live: the folder that the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN_FOLDER: list[str] = []


def new_location(spark: SparkSession, name: str) -> str:
    """A new location for a table that is written and read back.

    It lies in the folder that the session names in ``spark.checkpoint.dir``. Only a local
    session that names none gets a folder of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN_FOLDER:
            _OWN_FOLDER.append(tempfile.mkdtemp(prefix="run-"))
        shared = _OWN_FOLDER[0]
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
