"""The ``files`` corpus: one row per file.

    path STRING, root STRING, content STRING, size_bytes BIGINT,
    created_at TIMESTAMP, modified_at TIMESTAMP, valid_utf8 BOOLEAN
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from linetally.functions.paths import normalise
from linetally.sources.directory import MOST_BYTES, read_files

COLUMNS = ["path", "root", "content", "size_bytes", "created_at", "modified_at", "valid_utf8"]


def as_corpus(df: DataFrame, root: str | None = None) -> DataFrame:
    """Give any frame with ``path`` and ``content`` the full corpus schema.

    ``root`` names the corpus when the frame has no ``root`` column of its own. Binary
    content is decoded; files that are not UTF-8 get replacement characters and
    ``valid_utf8 = false``, and their size is that of the bytes. A ``place`` column (where a
    row lies, see ``operators.places``) is kept if there is one.
    """
    have = set(df.columns)
    binary = isinstance(df.schema["content"].dataType, BinaryType)
    text = F.col("content").cast("string")

    def given(name: str, default):
        return (F.col(name) if name in have else default).alias(name)

    return df.select(
        normalise(F.col("path")).alias("path"),
        given("root", F.lit(root if root is not None else ".")),
        (F.make_valid_utf8(text) if binary else F.col("content")).alias("content"),
        given("size_bytes", F.octet_length("content").cast("bigint")),
        given("created_at", F.lit(None).cast("timestamp")),
        given("modified_at", F.lit(None).cast("timestamp")),
        F.is_valid_utf8(text).alias("valid_utf8") if binary else given("valid_utf8", F.lit(True)),
        *[c for c in ("place",) if c in have],
    )


def read_corpus(spark: SparkSession, location: str, fmt: str = "parquet", root: str | None = None, max_bytes: int = MOST_BYTES) -> DataFrame:
    """Read a corpus table, or with ``fmt="binaryFile"`` a directory tree of files.

    A table is the primary form: it prunes columns and pushes path filters into the scan.
    A directory is listed and read by tasks, with every file in it, those whose names begin
    with a dot or an underscore included (Spark's own file listing leaves them out). Files of
    more than ``max_bytes`` are left to ``directory.skipped_files`` and ``directory.read_blocks``.
    """
    if fmt != "binaryFile":
        return as_corpus(spark.read.format(fmt).load(location), root)
    return as_corpus(read_files(spark, location, max_bytes), root if root is not None else location)


def read_many(spark: SparkSession, locations: dict[str, str], fmt: str = "parquet") -> DataFrame:
    """Union of several roots, given as ``{root: location}``."""
    return union_roots([read_corpus(spark, where, fmt, root) for root, where in locations.items()])


def union_roots(corpora: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, corpora)


def readable(files: DataFrame) -> DataFrame:
    """Files that are valid UTF-8: the ones text analysis looks at."""
    return files.filter("valid_utf8") if "valid_utf8" in files.columns else files
