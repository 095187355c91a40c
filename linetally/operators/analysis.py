"""Text analysis per file, naming checks and unused functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linetally.functions import analysis as A
from linetally.operators.rows import explode_once
from linetally.sources.corpus import readable


MEASURES = [
    "keyword_complexity",
    "functions_count",
    "todo_words",
    "docstrings_count",
    "typehints_count",
    "naming_violations",
]


def file_analysis(files: DataFrame, measures: Sequence[str] = MEASURES, keep: Sequence[str] = ()) -> DataFrame:
    """Line-based measures of every valid UTF-8 file.

    As in ``file_stats``, the measures leave through a one-element generator so that
    filters on them do not repeat the work; name the ``measures`` you need. Columns named
    in ``keep`` stay.
    """
    path, content, spaced = F.col("path"), F.col("content"), F.col("_spaced")
    padded = readable(files).select("root", "path", "content", *keep, A.spaced_lines(content).alias("_spaced"))
    named = padded.select("*", A.naming_violations(path, content).alias("naming_details"))
    expressions = {
        "keyword_complexity": lambda: A.keyword_complexity(spaced),
        "functions_count": lambda: A.functions_count(path, content, spaced),
        "todo_words": lambda: A.todo_words(content),
        "docstrings_count": lambda: A.docstring_count(path, content),
        "typehints_count": lambda: A.typehint_count(path, content),
        "naming_violations": lambda: F.size("naming_details").cast("bigint"),
    }
    wanted = [expressions[m]().alias(m) for m in MEASURES if m in measures]
    return named.select("root", "path", *keep, F.inline(F.array(F.struct(*wanted))))


def naming_violations(files: DataFrame) -> DataFrame:
    """``root, path, kind, name, rule``: one row per violation."""
    found = A.naming_violations(F.col("path"), F.col("content"))
    rows = explode_once(readable(files).select("root", "path", found.alias("found")), "found", "v")
    return rows.select("root", "path", "v.kind", "v.name", "v.rule")


def rename_suggestions(violations: DataFrame) -> DataFrame:
    return violations.withColumn("suggestion", A.rename_suggestion(F.col("name"), F.col("rule")))


def dead_code(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Function names that occur exactly once as a whole word: their definition.

    Definitions and occurrences travel as one stream of ``(name, is_definition)`` marks
    from a single read, and one grouped count decides. Words are counted per task before
    the shuffle, so a word found everywhere costs one row per task. No join, and names
    that contain each other do not disturb the count. ``by=("root",)`` judges each root
    alone; by default a use in any root counts.
    """
    path, content = F.col("path"), F.col("content")
    words = readable(files).select(*by, A.identifiers(content).alias("words"), A.defined_names(path, content).alias("names"))

    def mark(definition: bool):
        return lambda w: F.struct(w.alias("name"), F.lit(definition).alias("definition"))

    marks = F.concat(F.transform("words", mark(False)), F.transform("names", mark(True)))
    rows = explode_once(words.select(*by, marks.alias("marks")), "marks", "mark").select(*by, "mark.*")
    counted = rows.groupBy(*by, "name").agg(
        F.sum(F.when(F.col("definition"), 0).otherwise(1)).alias("uses"),
        F.max("definition").alias("defined"),
    )
    return counted.filter("defined AND uses = 1").select(*by, "name")
