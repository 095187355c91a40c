r"""Change history from exported logs.

The expected export separates commits with the record separator (0x1E) and the header
fields with the unit separator (0x1F), followed by numstat lines:

    git log --no-renames --diff-merges=first-parent --numstat --format='%x1e%H%x1f%an%x1f%ct'

A merge is compared with its first parent. Names that git quotes (bytes beyond ASCII,
quotes, tabs, backslashes) are unquoted; a backslash in a name stays one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linetally.functions.text import lines, utrim
from linetally.operators.rows import explode_once

RECORD, UNIT = "\x1e", "\x1f"


def read_log_records(spark: SparkSession, location: str) -> DataFrame:
    """One row (``value``) per commit record of the exported log files.

    The record separator is the line separator of the text source, so one log file is
    split over many tasks.
    """
    return spark.read.option("lineSep", RECORD).text(location)


def _headed(records: DataFrame) -> DataFrame:
    rows = lines(F.col("value"))
    header = F.split(F.get(rows, F.lit(0)), UNIT)
    author = F.get(header, F.lit(1))
    return records.filter(utrim(F.col("value")) != "").select(
        F.get(header, F.lit(0)).alias("commit_id"),
        F.when(author != "", author).alias("author"),
        F.timestamp_seconds(F.get(header, F.lit(2)).try_cast("bigint")).alias("ts"),
        rows.alias("rows"),
    )


def parse_commits(records: DataFrame) -> DataFrame:
    """``commits(commit_id, author, ts)``; an empty author name becomes null."""
    return _headed(records).select("commit_id", "author", "ts")


# Letters that git writes after a backslash, and the bytes they stand for.
_LETTERS = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, '"': 34, "\\": 92}


def unquoted(name: Column) -> Column:
    """A path as git's quoting (``core.quotePath``) means it; names without quotes as they are."""
    inner = F.substring(name, F.lit(2), F.length(name) - 2)
    pieces = F.regexp_extract_all(inner, F.lit(r'(\\[0-7]{3}|\\.|[^\\]+)'), F.lit(1))
    letters = F.create_map(*[F.lit(x) for k, v in _LETTERS.items() for x in (k, f"{v:02X}")])

    def as_hex(piece: Column) -> Column:
        number = F.conv(F.substring(piece, 2, 3), 8, 16)
        letter = F.substring(piece, 2, 1)
        escaped = F.when(letter.rlike("[0-7]"), F.lpad(number, 2, "0")).otherwise(F.coalesce(F.try_element_at(letters, letter), F.hex(letter)))
        return F.when(piece.startswith("\\"), escaped).otherwise(F.hex(piece))

    text = F.decode(F.unhex(F.array_join(F.transform(pieces, as_hex), "")), "UTF-8")
    return F.when(name.startswith('"') & name.endswith('"') & (F.length(name) > 1), text).otherwise(name)


def parse_changes(records: DataFrame) -> DataFrame:
    """``changes(commit_id, path, insertions, deletions)``; binary files (``-``) count 0."""
    numstat = F.filter(
        F.transform(F.col("rows"), lambda r: F.split(r, "\t", 3)),
        lambda parts: F.size(parts) == 3,
    )
    changed = explode_once(_headed(records).select("commit_id", numstat.alias("parts")), "parts", "part")

    def count(i: int):
        return F.coalesce(F.col("part")[i].try_cast("bigint"), F.lit(0)).cast("bigint")

    return changed.select(
        "commit_id",
        unquoted(F.col("part")[2]).alias("path"),
        count(0).alias("insertions"),
        count(1).alias("deletions"),
    )
