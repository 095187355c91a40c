"""Reuse of earlier statistics for unchanged files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from linetally.operators.places import only_listed
from linetally.operators.stats import file_stats

FILE_KEY = ["root", "path", "modified_at"]


def incremental_scan(listing: DataFrame, previous: DataFrame) -> DataFrame:
    """Statistics of exactly the listed files, rescanning only new and changed ones.

    A previous row is reused when its path is listed with the same ``modified_at``. Which
    files changed is decided on the keys alone; content is read only for those, and only
    their content is shuffled. A file without a modification time is always rescanned.
    """
    listed = listing.select(*FILE_KEY)
    known = previous.select(*FILE_KEY)
    reused = previous.join(listed, FILE_KEY, "left_semi")
    fresh = listed.join(known, FILE_KEY, "left_anti").select("root", "path")
    scanned = file_stats(only_listed(listing, fresh, ["root", "path"]))
    return reused.select(*scanned.columns).unionByName(scanned)
