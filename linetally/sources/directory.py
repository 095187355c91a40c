"""Directory trees as corpora: listed by frontiers, read whole or in byte ranges.

Listing goes in rounds. In each round tasks list the folders of the last one and go down
below them until they have seen a number of names; folders that are left over are the next round's
frontier, a table in the session's shared folder. The driver never holds names. Files are then dealt out:
a file is one row, or, where files may be of any size, a row is a range of it that begins
and ends at a line.

Works on file systems that Arrow opens (local, HDFS, S3, GCS). Names that begin with a dot
or an underscore count like all others; links to folders are followed as folders.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linetally.sources.store import new_location

#: Names after which a task leaves the folders below to the next round.
NAMES_A_ROUND = 20_000
#: A file of more bytes is not read as one row (a value in Spark ends at 2 GB).
MOST_BYTES = 1 << 30
BLOCK_BYTES = 4 << 20
#: Bytes of files that a task reads, about.
TASK_BYTES = 32 << 20
_FOUND = "path string, folder boolean, size_bytes bigint, modified_at timestamp, reason string"
_PART = 10_000


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    store, base = fs.FileSystem.from_uri(uri)
    return store, base.rstrip("/")


def location_uri(location: str) -> str:
    return location if "://" in location or location.startswith("file:") else os.path.abspath(location)


def _entries(store: fs.FileSystem, folder: str) -> tuple[list[fs.FileInfo], str | None]:
    try:
        return store.get_file_info(fs.FileSelector(folder)), None
    except OSError as error:
        return [], f"not listed: {type(error).__name__}"


def _listing(uri: str, most: int):
    """Lists folders (paths below the location), each down to ``most`` names."""

    def rows(found: list[tuple]) -> pa.RecordBatch:
        path, folder, size, time, reason = zip(*found, strict=True)
        kinds = (pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((path, folder, size, time, reason), kinds, strict=True)], names=["path", "folder", "size_bytes", "modified_at", "reason"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _opened(uri)
        for batch in batches:
            for start in batch.column(0).to_pylist():
                waiting, seen = [start], 0
                while waiting:
                    folder = waiting.pop()
                    if seen and seen >= most:
                        yield rows([(folder, True, None, None, None)])
                        continue
                    infos, reason = _entries(store, f"{base}/{folder}" if folder else base)
                    seen += len(infos) + 1
                    if reason:
                        yield rows([(folder, False, None, None, reason)])
                    found = []
                    for info in infos:
                        path = info.path[len(base) :].lstrip("/")
                        if info.type == fs.FileType.Directory:
                            waiting.append(path)
                        elif info.type == fs.FileType.File:
                            found.append((path, False, info.size, info.mtime, None))
                        else:
                            found.append((path, False, None, None, "not a file"))
                    for i in range(0, len(found), _PART):
                        yield rows(found[i : i + _PART])

    return run


def list_files(spark: SparkSession, location: str, names_a_round: int = NAMES_A_ROUND) -> DataFrame:
    """``path, size_bytes, modified_at, reason`` of all files below a folder; paths begin there.

    ``reason`` is null for a file that can be opened, else why not (a folder that can't be
    listed has a row of its own). A location that is not there is an error. Each round is one job.
    """
    uri = location_uri(location)
    store, base = _opened(uri)
    if store.get_file_info(base).type != fs.FileType.Directory:
        raise FileNotFoundError(f"no folder: {location}")
    frontier = spark.createDataFrame([("",)], "path string")
    rounds = []
    while True:
        where = new_location(spark, "listing")
        frontier.mapInArrow(_listing(uri, names_a_round), _FOUND).write.parquet(where)
        found = spark.read.schema(_FOUND).parquet(where)
        rounds.append(found.where("NOT folder").drop("folder"))
        frontier = found.where("folder").select("path").repartition("path")
        if not frontier.take(1):
            return reduce(DataFrame.unionByName, rounds)


def _dealt(rows: DataFrame, files: DataFrame, *by: str) -> DataFrame:
    """Rows that name what is to be read, dealt out to tasks by the bytes of the files.

    The number of tasks is given: these rows are so short that Spark, left to choose, would put all of
    them into one task, and with them the reading and what follows it.
    """
    total = files.agg(F.sum("size_bytes")).first()[0] or 0
    return rows.repartition(max(files.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES)), *by)


def _read_whole(uri: str):
    names = ["path", "content", "size_bytes", "modified_at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _opened(uri)
        for batch in batches:
            for i, path in enumerate(batch.column(0).to_pylist()):
                with store.open_input_stream(f"{base}/{path}") as file:
                    content = file.read()
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([row.column(0), pa.array([content], pa.binary()), row.column(1), row.column(2)], names=names)

    return run


def read_files(spark: SparkSession, location: str, max_bytes: int = MOST_BYTES) -> DataFrame:
    """``path, content, size_bytes, modified_at`` of the files of at most ``max_bytes``.

    The others are those of ``skipped_files``; ``read_blocks`` reads files of any size.
    """
    files = list_files(spark, location).where(F.col("reason").isNull() & (F.col("size_bytes") <= max_bytes))
    dealt = _dealt(files.select("path", "size_bytes", "modified_at"), files, "path")
    return dealt.mapInArrow(_read_whole(location_uri(location)), "path string, content binary, size_bytes bigint, modified_at timestamp")


def skipped_files(spark: SparkSession, location: str, max_bytes: int = MOST_BYTES) -> DataFrame:
    """``path, reason`` of what ``read_files`` leaves out: files that are too large or no files."""
    large = F.format_string("larger than %d bytes", F.lit(max_bytes))
    reason = F.coalesce("reason", F.when(F.col("size_bytes") > max_bytes, large))
    return list_files(spark, location).select("path", reason.alias("reason")).where("reason IS NOT NULL")


def lines_of_range(file, start: int, end: int, step: int = 1 << 16) -> bytes:
    """The lines of a file that begin in ``start:end``; the last one is read to its end."""
    if start:
        # A line begins at start if the byte before ends one; else the first line is the last range's.
        file.seek(start - 1)
        at = start - 1
        while True:
            piece = file.read(min(step, max(end - at, 1)))
            if not piece:
                return b""
            cut = piece.find(b"\n")
            if cut >= 0:
                start = at + cut + 1
                break
            at += len(piece)
            if at >= end:
                return b""
        if start >= end:
            return b""
    file.seek(start)
    parts = [file.read(end - start)]
    while not parts[-1].endswith(b"\n"):
        piece = file.read(step)
        cut = piece.find(b"\n")
        parts.append(piece if cut < 0 else piece[: cut + 1])
        if not piece or cut >= 0:
            break
    return b"".join(parts)


def _read_ranges(uri: str):
    names = ["path", "block_no", "content", "modified_at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _opened(uri)
        for batch in batches:
            for i, (path, start, end) in enumerate(zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True)):
                with store.open_input_file(f"{base}/{path}") as file:
                    content = lines_of_range(file, start, end)
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([row.column(0), row.column(3), pa.array([content], pa.binary()), row.column(4)], names=names)

    return run


def read_blocks(spark: SparkSession, location: str, root: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``root, path, block_no, content, valid_utf8, modified_at``: files of any size as blocks of whole lines.

    A block holds the lines that begin in its range of bytes, so it may be empty, and only a
    line longer than a range makes it longer. A long file is read by as many tasks as it has
    ranges. Made for ``long_files.block_stats``.
    """
    files = list_files(spark, location).where(F.col("reason").isNull())
    last = F.greatest(F.ceil(F.col("size_bytes") / block_bytes), F.lit(1)) - 1
    cut = files.select("path", "size_bytes", "modified_at", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block_no"))
    start = F.col("block_no") * block_bytes
    ranges = cut.select("path", start.alias("start"), F.least(start + block_bytes, F.col("size_bytes")).alias("end"), "block_no", "modified_at")
    dealt = _dealt(ranges, files, "path", "block_no")
    blocks = dealt.mapInArrow(_read_ranges(location_uri(location)), "path string, block_no bigint, content binary, modified_at timestamp")
    text = F.col("content").cast("string")
    return blocks.select(
        F.lit(root if root is not None else location).alias("root"),
        "path",
        "block_no",
        F.make_valid_utf8(text).alias("content"),
        F.is_valid_utf8(text).alias("valid_utf8"),
        "modified_at",
    )
