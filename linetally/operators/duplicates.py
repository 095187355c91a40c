"""Blocks of five consecutive (non-trivial) lines that occur more than once.

Block text never crosses the network. Each line is hashed once per file to 128 bits,
and blocks are hashes of five line hashes. Two passes find the repeated ones: the first
counts keys alone, as numbers, with partial counts in every task, so a boilerplate header
found in a third of all files is one row per task; the second takes places, and lets through
only those of repeated blocks. Locations are cut to the first few per block on the map side
too, and the preview text is read from one file per reported block. Previews of files with places
take a job of their own (``places.only_listed``), so what it and the result share is stored, not found twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linetally.functions.text import numbered_lines, utrim
from linetally.operators.places import PLACE, only_listed
from linetally.operators.rows import explode_once, first_rows, likely_listed
from linetally.sources.corpus import readable
from linetally.sources.store import new_location

BLOCK_LINES = 5
MIN_LINE_BYTES = 3
KEY = ["scope", "key_a", "key_b"]


def _scoped(files: DataFrame, across_roots: bool) -> DataFrame:
    """Add ``scope``: the root (blocks are compared within one root) or ``*``."""
    return files.withColumn("scope", F.lit("*") if across_roots else F.col("root"))


def _kept_lines(content: Column) -> Column:
    """``ARRAY<STRUCT<line_no, line>>``: trimmed lines longer than three bytes."""
    trimmed = F.transform(
        numbered_lines(content), lambda x: F.struct(x["line_no"].alias("line_no"), utrim(x["line"]).alias("line"))
    )
    return F.filter(trimmed, lambda x: F.octet_length(x["line"]) > MIN_LINE_BYTES)


def block_keys(files: DataFrame, across_roots: bool = False) -> DataFrame:
    """``scope, key_a, key_b, root, path, line_no``: one row per block of every file.

    Store this table to search for duplicates repeatedly without reading the content.
    """
    scoped = _scoped(readable(files), across_roots)
    kept = scoped.select("scope", "root", "path", _kept_lines(F.col("content")).alias("kept"))
    hashed = kept.select(
        "scope",
        "root",
        "path",
        F.transform(
            "kept",
            lambda x: F.struct(
                x["line_no"].alias("line_no"),
                F.xxhash64(x["line"]).alias("a"),
                F.xxhash64(F.lit("second"), x["line"]).alias("b"),
            ),
        ).alias("h"),
    )

    def block(i: Column) -> Column:
        rows = [F.get("h", i + k) for k in range(BLOCK_LINES)]
        return F.struct(
            rows[0]["line_no"].alias("line_no"),
            F.xxhash64(*[r["a"] for r in rows]).alias("key_a"),
            F.xxhash64(*[r["b"] for r in rows]).alias("key_b"),
        )

    enough = F.size("h") >= BLOCK_LINES  # a filter here would be evaluated on the lines again
    starts = F.when(enough, F.sequence(F.lit(0), F.size("h") - BLOCK_LINES))
    blocks = hashed.select("scope", "root", "path", F.transform(starts, block).alias("blocks"))
    rows = explode_once(blocks, "blocks", "b")
    return rows.select("scope", "b.key_a", "b.key_b", "root", "path", "b.line_no")


def counted_keys(keys: DataFrame, top: int | None = None) -> DataFrame:
    """``scope, key_a, key_b, occurrences`` of keys seen more than once, of numbers only.

    ``top`` keeps those that are among the most frequent of their scope, ties included.
    """
    counted = keys.groupBy(*KEY).agg(F.count("*").alias("occurrences")).filter("occurrences > 1")
    if top is None:
        return counted
    place = F.rank().over(Window.partitionBy("scope").orderBy(F.desc("occurrences")))
    return counted.withColumn("_place", place).filter(F.col("_place") <= top).drop("_place")


def repeated_keys(keys: DataFrame, top: int | None = None, hot: DataFrame | None = None) -> DataFrame:
    """Keys seen more than once with ``occurrences`` and their ``first`` place.

    ``top`` keeps the most frequent per scope and ranks them (ties by first place). Only
    places of the counted keys are shuffled. ``hot`` takes stored ``counted_keys`` of that ``top``.
    """
    hot = counted_keys(keys, top) if hot is None else hot
    place = F.min(F.struct("path", "root", "line_no")).alias("first")
    found = likely_listed(keys, hot, KEY).groupBy(*KEY).agg(place).join(hot, KEY, "inner")
    if top is None:
        return found
    return first_rows(found, ["scope"], [F.desc("occurrences"), "first"], top, "block_rank", "key_a")


def duplicate_locations(
    keys: DataFrame, top: int | None = 10, locations: int | None = 5, hot: DataFrame | None = None
) -> DataFrame:
    """Repeated blocks with their first ``locations`` places (``None``: all of them).

    A filter of the repeated keys keeps places of other blocks, which are nearly all, from being
    shuffled or sorted, and each task hands on the first places of a block only. ``hot`` takes stored
    ``repeated_keys`` of that ``top``.
    """
    if hot is None:
        hot = counted_keys(keys) if top is None else repeated_keys(keys, top)
    hot = hot.drop("first")
    places = likely_listed(keys, hot, KEY)
    if locations is not None:
        places = first_rows(places, KEY, ["path", "root", "line_no"], locations, "location_no", "path")
    return places.join(hot, KEY, "inner")


def _previews(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """``root, path, line_no, preview`` of blocks that begin at the wanted ``root, path, line_no``.

    Text of files that hold none is neither cut nor moved.
    """
    starts = wanted.groupBy("root", "path").agg(F.collect_set("line_no").alias("starts"))
    shown = only_listed(readable(files), starts, ["root", "path"]).join(starts, ["root", "path"], "inner")
    kept = shown.select("root", "path", "starts", _kept_lines(F.col("content")).alias("kept"))

    def preview(i: Column) -> Column:
        block = F.transform(F.slice("kept", i + 1, BLOCK_LINES), lambda x: x["line"])
        return F.struct(F.get("kept", i)["line_no"].alias("line_no"), F.array_join(block, "\n").alias("preview"))

    picked = F.filter(
        F.sequence(F.lit(0), F.size("kept") - BLOCK_LINES),
        lambda i: F.array_contains(F.col("starts"), F.get("kept", i)["line_no"]),
    )
    previews = explode_once(kept.select("root", "path", F.transform(picked, preview).alias("p")), "p", "p1")
    return previews.select("root", "path", "p1.line_no", "p1.preview")


def _shared(found: DataFrame, files: DataFrame) -> DataFrame:
    """``found``, stored if previews of these files take a job of their own."""
    if PLACE not in files.columns:
        return found
    where = new_location(files.sparkSession, "blocks")
    found.write.parquet(where)
    return files.sparkSession.read.parquet(where)


def _repeated(files: DataFrame, keys: DataFrame, top: int | None) -> DataFrame:
    """``repeated_keys`` for a result that also shows previews."""
    return _shared(repeated_keys(keys, top, _shared(counted_keys(keys, top), files)), files)


def duplicate_blocks(
    files: DataFrame, top: int | None = 10, across_roots: bool = False, keys: DataFrame | None = None
) -> DataFrame:
    """Repeated blocks: ``scope, occurrences, root, path, line_no, preview`` of the first place.

    ``keys`` takes a stored ``block_keys`` table. The preview is cut from the file that
    holds the first place.
    """
    keys = block_keys(files, across_roots) if keys is None else keys
    first = _repeated(files, keys, top).select("scope", "occurrences", "first.root", "first.path", "first.line_no")
    return first.join(_previews(files, first), ["root", "path", "line_no"], "inner").select(
        "scope", "occurrences", "root", "path", "line_no", "preview"
    )


def duplicate_report(files: DataFrame, top: int = 10, locations: int = 5, across_roots: bool = False) -> DataFrame:
    """The ``top`` repeated blocks of each scope with their text and first places.

    ``scope, block_rank, occurrences, location_no, root, path, line_no, preview``
    """
    keys = block_keys(files, across_roots)
    hot = _repeated(files, keys, top)
    first = hot.select(*KEY, "block_rank", "first.root", "first.path", "first.line_no")
    text = first.join(_previews(files, first), ["root", "path", "line_no"], "inner").select(*KEY, "preview")
    return duplicate_locations(keys, top, locations, hot).join(text, KEY, "inner").select(
        "scope", "block_rank", "occurrences", "location_no", "root", "path", "line_no", "preview"
    )
