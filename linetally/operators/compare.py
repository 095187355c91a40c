"""Comparison of two corpora, and single-file reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linetally.operators.analysis import MEASURES, file_analysis
from linetally.operators.stats import file_stats


def compare_corpora(first: DataFrame, second: DataFrame) -> DataFrame:
    """Files and lines by language on both sides, differences (second minus first), total.

    Both sides are stacked with a side mark and grouped once: the union of languages,
    with 0 for a missing side, needs no join.
    """
    stacked = first.select("language", "lines", F.lit(1).alias("side")).unionByName(
        second.select("language", "lines", F.lit(2).alias("side"))
    )

    def of(side: int, value):
        return F.sum(F.when(F.col("side") == side, value).otherwise(F.lit(0)))

    by_lang = stacked.groupBy("language").agg(
        of(1, F.lit(1)).alias("files_1"),
        of(2, F.lit(1)).alias("files_2"),
        of(1, F.col("lines")).alias("lines_1"),
        of(2, F.col("lines")).alias("lines_2"),
    )
    sides = ["files_1", "files_2", "lines_1", "lines_2"]
    rolled = by_lang.rollup("language").agg(
        F.grouping("language").alias("_g"), *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in sides]
    )
    return rolled.select(
        F.when(F.col("_g") == 1, F.lit("Total")).otherwise(F.col("language")).alias("language"),
        "files_1",
        "files_2",
        (F.col("files_2") - F.col("files_1")).alias("files_diff"),
        "lines_1",
        "lines_2",
        (F.col("lines_2") - F.col("lines_1")).alias("lines_diff"),
        (F.col("_g") == 1).alias("is_total"),
    ).orderBy("is_total", "language")


def file_report(files: DataFrame, paths: Iterable[str] | None = None) -> DataFrame:
    """Statistics and analysis of the given paths side by side.

    The path filter reaches the scan before any text is looked at. ``has_stats`` and
    ``has_analysis`` tell which part is missing: a file that is not valid UTF-8 has no
    analysis, a requested path that is not in the corpus has neither. Both parts are
    columns of one pass over the text.
    """
    asked = None
    if paths is not None:
        wanted = list(dict.fromkeys(p.replace("\\", "/") for p in paths))
        asked = files.sparkSession.createDataFrame([(p,) for p in wanted], "path string")
        files = files.join(F.broadcast(asked), "path", "left_semi")
    valid = F.col("valid_utf8") if "valid_utf8" in files.columns else F.lit(True)
    facts = file_stats(files.withColumn("_valid", valid), keep=("content", "_valid"))
    facts = facts.withColumn("content", F.when(F.col("_valid"), F.col("content")))
    kept = [c for c in facts.columns if c not in ("root", "path", "content")]
    both = file_analysis(facts, keep=kept)
    report = both.select(
        *[c for c in both.columns if c not in (*MEASURES, "_valid")],
        *[F.when(F.col("_valid"), F.col(c)).alias(c) for c in MEASURES],
        F.lit(True).alias("has_stats"),
        F.col("_valid").alias("has_analysis"),
    )
    if asked is None:
        return report
    joined = F.broadcast(asked).join(report, "path", "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("has_stats", "has_analysis")]
    return joined.select(*[c for c in report.columns if c not in ("has_stats", "has_analysis")], *flags)
