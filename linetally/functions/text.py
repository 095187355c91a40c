"""Line and whitespace primitives as column expressions.

All of them stay inside the JVM; the ones that only need byte counts or the two
ends of a string avoid regular expressions altogether.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters with the Unicode White_Space property.
WHITE_SPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def utrim(value: Column) -> Column:
    """Trim every Unicode white-space character (Spark's ``trim`` removes only U+0020)."""
    return F.btrim(value, F.lit(WHITE_SPACE))


def occurrences(value: Column, needle: str) -> Column:
    """Count non-overlapping occurrences of a literal without a regular expression."""
    width = len(needle.encode("utf-8"))
    removed = F.octet_length(value) - F.octet_length(F.replace(value, F.lit(needle), F.lit("")))
    return (removed / F.lit(width)).cast("bigint") if width > 1 else removed.cast("bigint")


def line_count(content: Column) -> Column:
    """Number of lines: one per ``\\n`` plus an unterminated last line; ``''`` has none."""
    unterminated = (F.octet_length(content) > 0) & ~content.endswith("\n")
    return occurrences(content, "\n") + unterminated.cast("bigint")


def without_final_newline(content: Column) -> Column:
    """Drop one final ``\\n`` or ``\\r\\n``."""
    return (
        F.when(content.endswith("\r\n"), F.substring(content, F.lit(1), F.length(content) - 2))
        .when(content.endswith("\n"), F.substring(content, F.lit(1), F.length(content) - 1))
        .otherwise(content)
    )


def lines(content: Column) -> Column:
    """Array of lines split at ``\\n`` or ``\\r\\n``; ``''`` gives an empty array.

    A last line that ends in a lone ``\\r`` keeps it.
    """
    return F.when(F.octet_length(content) == 0, F.array().cast("array<string>")).otherwise(
        F.split(without_final_newline(content), "\r?\n")
    )


def numbered_lines(content: Column) -> Column:
    """Array of ``struct(line_no, line)`` with 1-based line numbers."""
    return F.transform(
        lines(content),
        lambda line, i: F.struct((i + 1).cast("bigint").alias("line_no"), line.alias("line")),
    )
