"""Rankings and per-file views over the statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linetally.functions import scores
from linetally.operators.filters import COMPLEXITY_THRESHOLD, LARGE_FILE_LINES, with_lines


def top_files(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` longest files, with ``lines``; in no order if a corpus is given.

    Statistics are ranked as they are. Of a corpus only newlines are counted for the
    ranking, which carries no text: the ``n`` winning names are broadcast back to it. A file
    that a corpus lists more than once comes with all its rows.
    """
    if "content" not in df.columns:
        return with_lines(df).orderBy(F.desc("lines"), "path", "root").limit(n)
    longest = with_lines(df).select("root", "path", "lines").orderBy(F.desc("lines"), "path", "root").limit(n)
    return df.join(F.broadcast(longest.distinct()), ["root", "path"], "inner").select(*df.columns, "lines")


def details(stats: DataFrame, as_of: Column) -> DataFrame:
    """The per-file table with sizes and ages."""
    return stats.select(
        "path",
        "root",
        "language",
        "lines",
        F.col("code_lines").alias("code"),
        F.col("comment_lines").alias("comments"),
        F.col("blank_lines").alias("blanks"),
        "complexity",
        "size_bytes",
        scores.age_bucket(F.col("modified_at"), as_of).alias("modified"),
        scores.age_bucket(F.col("created_at"), as_of).alias("created"),
    )


def complexity_bands(stats: DataFrame) -> DataFrame:
    return stats.select(
        "root", "path", "complexity", scores.complexity_band(F.col("complexity")).alias("band")
    ).orderBy("path", "root")


def top_complex_files(stats: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` most complex files, with complexity relative to the highest."""
    top = stats.select("root", "path", "complexity").orderBy(F.desc("complexity"), "path", "root").limit(n)
    highest = F.max("complexity").over(Window.partitionBy(F.lit(1)))  # at most n rows
    return top.withColumn("relative", scores.ratio(F.col("complexity"), highest))


def file_extremes(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The longest and the shortest file (ties: last and first path)."""
    size = F.struct("lines", "path")
    return (
        with_lines(df)
        .groupBy(*by)
        .agg(
            F.max(size).alias("most"),
            F.min(size).alias("least"),
        )
        .select(
            *by,
            F.col("most.path").alias("largest_path"),
            F.col("most.lines").alias("largest_lines"),
            F.col("least.path").alias("smallest_path"),
            F.col("least.lines").alias("smallest_lines"),
        )
    )


def top_languages(sizes: DataFrame, n: int = 5) -> DataFrame:
    """Languages by lines, blank names skipped; ``n=1`` gives the primary language."""
    named = sizes.filter(F.trim("language") != "")
    grouped = named.groupBy("language").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))
    return grouped.orderBy(F.desc("lines"), "language").limit(n)


def refactor_candidates(
    stats: DataFrame, complexity_threshold: float = COMPLEXITY_THRESHOLD, max_lines: int = LARGE_FILE_LINES
) -> DataFrame:
    """Files that are too long or too complex, with reasons and advice (fixed texts)."""
    # The reasons and the advice.
    lines, complexity = F.col("lines"), F.col("complexity")
    long, tangled = lines > max_lines, complexity >= complexity_threshold
    reasons = F.array_compact(F.array(F.when(long, F.lit("High lines")), F.when(tangled, F.lit("High complexity"))))
    advice = F.array_compact(
        F.array(
            F.when(
                long,
                F.format_string(
                    f"Has %d lines (threshold: {max_lines}). Consider breaking it into smaller files.", lines
                ),
            ),
            F.when(
                tangled,
                F.format_string(
                    f"Has high complexity (%.1f >= {complexity_threshold:.1f}). "
                    "Consider simplifying logic or extracting functions.",
                    complexity,
                ),
            ),
        )
    )
    judged = stats.select(
        "root",
        "path",
        "lines",
        "complexity",
        F.array_join(reasons, ", ").alias("reasons"),
        F.array_join(advice, " ").alias("advice"),
    )
    return judged.filter((lines > max_lines) | (complexity >= complexity_threshold))
