"""Report tables and their writers.

The ``*_rows`` functions shape a report; the ``write_*`` functions store it. Reports on
languages or directories are small next to the corpus; the others are written in
parallel, one file per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linetally.operators.stats import dir_stats, lang_stats


def lang_json_rows(stats: DataFrame) -> DataFrame:
    return lang_stats(stats).orderBy(F.desc("lines"), "language")


def lang_csv_rows(stats: DataFrame) -> DataFrame:
    rows = lang_stats(stats).orderBy(F.desc("lines"), "language")
    return rows.select(
        F.col("language").alias("Extension"),
        F.col("files").alias("Files"),
        F.col("lines").alias("Lines"),
        F.col("code_lines").alias("Code"),
        F.col("comment_lines").alias("Comments"),
        F.col("blank_lines").alias("Blanks"),
    )


def details_csv_rows(stats: DataFrame, semicolons: bool = False) -> DataFrame:
    """Per-file rows. Paths with commas are quoted by the writer; ``semicolons`` replaces
    the commas instead."""
    path = F.translate("path", ",", ";") if semicolons else F.col("path")
    return stats.select(
        path.alias("Path"),
        F.col("language").alias("Extension"),
        F.col("lines").alias("Lines"),
        F.col("code_lines").alias("Code"),
        F.col("comment_lines").alias("Comments"),
        F.col("blank_lines").alias("Blanks"),
        F.format_string("%.1f", "complexity").alias("Complexity"),
    )


def dir_csv_rows(stats: DataFrame, semicolons: bool = False) -> DataFrame:
    directory = F.translate("directory", ",", ";") if semicolons else F.col("directory")
    return dir_stats(stats, by=()).select(
        directory.alias("Directory"),
        F.col("files").alias("Files"),
        F.col("lines").alias("Lines"),
        F.col("code_lines").alias("Code"),
        F.col("comment_lines").alias("Comments"),
    )


def _write_csv(rows: DataFrame, location: str, mode: str) -> None:
    rows.write.mode(mode).option("header", True).csv(location)


def write_lang_json(stats: DataFrame, location: str, mode: str = "errorifexists") -> None:
    lang_json_rows(stats).write.mode(mode).json(location)


def write_lang_csv(stats: DataFrame, location: str, mode: str = "errorifexists") -> None:
    _write_csv(lang_csv_rows(stats), location, mode)


def write_details_csv(stats: DataFrame, location: str, mode: str = "errorifexists", semicolons: bool = False) -> None:
    _write_csv(details_csv_rows(stats, semicolons), location, mode)


def write_dir_csv(stats: DataFrame, location: str, mode: str = "errorifexists", semicolons: bool = False) -> None:
    _write_csv(dir_csv_rows(stats, semicolons), location, mode)


def write_issues_json(issues: DataFrame, location: str, mode: str = "errorifexists") -> None:
    issues.write.mode(mode).json(location)


def write_documents(documents: DataFrame, location: str, mode: str = "errorifexists") -> None:
    """Store JSON documents (SARIF, OpenAPI), one per line, in one directory per root."""
    documents.select("root", F.col("document").alias("value")).write.mode(mode).partitionBy("root").text(location)
