"""Directory structure from paths alone; the content column is never read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linetally.functions.paths import components
from linetally.operators.rows import explode_once

TOP = "root"


def _prefix(parts: Column, n: Column) -> Column:
    return F.array_join(F.slice(parts, F.lit(1), n), "/")


def node_id(name: Column) -> Column:
    return F.translate(name, "/.-\\", "____")


def structure_edges(files: DataFrame) -> DataFrame:
    """``root, parent, child, name, kind, parent_id, child_id``.

    Distinct directory-to-directory edges below the node ``root``, and one
    directory-to-file edge per file.
    """
    parts = files.select("root", components(F.col("path")).alias("parts"))
    depth = F.size("parts")

    def up(n: Column) -> Column:
        return F.when(n == 0, F.lit(TOP)).otherwise(_prefix(F.col("parts"), n))

    def folder(n: Column) -> Column:
        return F.struct(
            up(n - 1).alias("parent"), _prefix(F.col("parts"), n).alias("child"), F.get("parts", n - 1).alias("name")
        )

    levels = F.when(depth > 1, F.transform(F.sequence(F.lit(1), depth - 1), folder))
    folders = explode_once(parts.select("root", levels.alias("levels")), "levels", "edge")
    folders = folders.select("root", "edge.*").distinct().withColumn("kind", F.lit("directory"))
    leaves = parts.select(
        "root",
        up(depth - 1).alias("parent"),
        F.array_join("parts", "/").alias("child"),
        F.get("parts", depth - 1).alias("name"),
        F.lit("file").alias("kind"),
    )
    edges = folders.unionByName(leaves)
    parent = node_id(F.col("parent"))
    child = F.when(F.col("kind") == "file", F.concat(parent, F.lit("_"), node_id(F.col("name")))).otherwise(
        node_id(F.col("child"))
    )
    return edges.select("*", parent.alias("parent_id"), child.alias("child_id"))


def tree_listing(files: DataFrame) -> DataFrame:
    """``root, path, name, depth, kind``: every directory and file, in tree order.

    Only directories repeat, so only they are made distinct; files go straight to the sort.
    A file listed twice has two rows.
    """
    parts = files.select("root", components(F.col("path")).alias("parts"))
    depth = F.size("parts")

    def entry(n: Column, kind: str) -> Column:
        return F.struct(
            _prefix(F.col("parts"), n).alias("path"),
            F.get("parts", n - 1).alias("name"),
            n.cast("bigint").alias("depth"),
            F.lit(kind).alias("kind"),
        )

    levels = F.when(depth > 1, F.transform(F.sequence(F.lit(1), depth - 1), lambda n: entry(n, "directory")))
    folders = explode_once(parts.select("root", levels.alias("levels")), "levels", "e").select("root", "e.*").distinct()
    leaves = parts.select("root", entry(depth, "file").alias("e")).select("root", "e.*")
    return folders.unionByName(leaves).orderBy("root", components(F.col("path")))
