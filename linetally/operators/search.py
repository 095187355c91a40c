"""Line search and style checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linetally.functions.text import numbered_lines, utrim
from linetally.operators.rows import explode_once
from linetally.sources.corpus import readable

MAX_LINE_CHARS = 100


def grep(files: DataFrame, pattern: str) -> DataFrame:
    """Lines matching an unanchored pattern: ``root, path, line_no, line`` (trimmed).

    Lines that do not match never leave the row of their file. Undecodable bytes were
    replaced when the corpus was read.
    """
    test = f"(?Ud){pattern}"  # of all line ends only \\n is one
    hits = F.filter(numbered_lines(F.col("content")), lambda x: x["line"].rlike(test))
    found = explode_once(files.select("root", "path", hits.alias("hits")), "hits", "hit")
    return found.select("root", "path", "hit.line_no", utrim(F.col("hit.line")).alias("line"))


def style_issues(files: DataFrame, max_chars: int = MAX_LINE_CHARS) -> DataFrame:
    """``root, path, line_no, issue``: trailing blanks and long lines per line, and a missing
    final newline per file (``line_no`` null)."""
    content = F.col("content")

    def of_line(x):
        line = x["line"]
        return F.array_compact(
            F.array(
                F.when(
                    line.endswith(" ") | line.endswith("\t"),
                    F.struct(x["line_no"].alias("line_no"), F.lit("Trailing whitespace").alias("issue")),
                ),
                F.when(
                    F.char_length(line) > max_chars,
                    F.struct(x["line_no"].alias("line_no"), F.lit(f"Line exceeds {max_chars} characters").alias("issue")),
                ),
            )
        )

    no_end = (F.octet_length(content) > 0) & ~content.endswith("\n")
    at_end = F.array_compact(
        F.array(
            F.when(
                no_end,
                F.struct(
                    F.lit(None).cast("bigint").alias("line_no"), F.lit("Missing newline at end of file").alias("issue")
                ),
            )
        )
    )
    found = F.concat(F.flatten(F.transform(numbered_lines(content), of_line)), at_end)
    rows = explode_once(readable(files).select("root", "path", found.alias("found")), "found", "f")
    return rows.select("root", "path", "f.line_no", "f.issue")
