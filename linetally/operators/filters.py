"""Row filters over ``files`` or per-file statistics."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linetally.functions.paths import components, extension_of, normalise
from linetally.functions.text import line_count
from linetally.operators.places import only_listed

# When a file is long or tangled.
LARGE_FILE_LINES = 300
COMPLEXITY_THRESHOLD = 10.0


def exclude_components(df: DataFrame, names: Iterable[str] = ()) -> DataFrame:
    """Drop a path when one of its directory or file names is excluded; ``.git`` always is."""
    dropped = F.array(*[F.lit(n) for n in dict.fromkeys([".git", *names])])
    return df.filter(~F.arrays_overlap(components(F.col("path")), dropped))


def filter_ext(df: DataFrame, extensions: Iterable[str] | str) -> DataFrame:
    """Keep extensions given as a list or comma list, with or without a leading dot.

    The match is case-sensitive and files without an extension drop out.
    """
    if isinstance(extensions, str):
        extensions = [e.strip() for e in extensions.split(",")]
    wanted = [e[1:] if e.startswith(".") else e for e in extensions]
    return df.filter(extension_of(F.col("path")).isin(wanted))


def is_pattern(df: DataFrame, pattern: str) -> bool:
    """Whether Spark accepts a regular expression (a constant-folded one-row query)."""
    try:
        df.sparkSession.range(1).select(F.lit("").rlike(pattern)).collect()
    except PySparkException:
        return False
    return True


def filter_path_regex(df: DataFrame, patterns: Iterable[str]) -> DataFrame:
    """Keep a path that any valid pattern matches; invalid patterns are ignored, and
    without a valid one nothing is filtered."""
    valid = [p for p in (f"(?Ud){p}" for p in patterns) if is_pattern(df, p)]
    if not valid:
        return df
    path = normalise(F.col("path"))
    return df.filter(reduce(or_, [path.rlike(p) for p in valid]))


def with_lines(df: DataFrame) -> DataFrame:
    """Add ``lines`` to a corpus. Counting newlines needs no lexemes, so size filters and
    rankings can run before the full scan of the few files they keep."""
    return df if "lines" in df.columns else df.withColumn("lines", line_count(F.col("content")))


def min_lines(df: DataFrame, n: int) -> DataFrame:
    return with_lines(df).filter(F.col("lines") >= n)


def large_files(df: DataFrame, threshold: int = LARGE_FILE_LINES) -> DataFrame:
    return with_lines(df).filter(F.col("lines") > threshold)


def failures_only(
    stats: DataFrame, complexity_threshold: float = COMPLEXITY_THRESHOLD, max_lines: int = LARGE_FILE_LINES
) -> DataFrame:
    return stats.filter((F.col("lines") > max_lines) | (F.col("complexity") >= complexity_threshold))


def uncommitted(df: DataFrame, changed_paths: DataFrame) -> DataFrame:
    """Keep files listed in ``changed_paths(root, path)``, compared on the root-relative path."""
    return only_listed(df, changed_paths, ["root", "path"])


def drop_small_shares(shares: DataFrame, percent: float = 0.1) -> DataFrame:
    """Drop languages with lines but less than ``percent`` of all lines."""
    return shares.filter(~((F.col("lines_pct") < percent) & (F.col("lines") > 0)))
