"""Per-file statistics and the rollups over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linetally.functions import lexer, scores
from linetally.functions.language import language_sql, style_sql
from linetally.functions.paths import parent_dir
from linetally.operators.rows import with_totals

COUNTERS = ["lines", "blank_lines", "comment_lines", "code_lines", "complexity", "todo_count", "secrets_found"]

_FACTS = ["path", "root", "size_bytes", "created_at", "modified_at"]

SORT_KEYS = {
    "files": "files",
    "lines": "lines",
    "code": "code_lines",
    "comments": "comment_lines",
    "blanks": "blank_lines",
    "complexity": "complexity",
    "todos": "todo_count",
}


def file_stats(files: DataFrame, counters: Sequence[str] = COUNTERS, keep: Sequence[str] = ()) -> DataFrame:
    """One row of counters per file, in one pass over the content and without a shuffle.

    The chunk array and the texts derived from it are separate projections: each is used
    several times above, so the optimizer keeps it computed once. The finished counters
    leave through a one-element generator, because a filter on them would otherwise be
    pushed down to the content and repeat the whole scan inside the filter condition.
    Name the ``counters`` you need to skip the work behind the others. At scale, write
    the result as a table once and run every view on that. Columns named in ``keep`` stay.
    """
    others = [c for c in keep if c != "content"]
    styled = files.selectExpr(*_FACTS, "content", *others, f"{style_sql('path')} AS _style")
    cut = styled.selectExpr("*", f"{lexer.chunks('content', '_style')} AS _chunks")
    texts = cut.selectExpr(
        "*",
        f"{lexer.skeleton('_chunks', '_style')} AS _skeleton",
        f"{lexer.code_text('_chunks', '_style')} AS _code",
        f"{lexer.note_text('_chunks', '_style')} AS _notes",
    )
    counted = texts.selectExpr(
        "*",
        f"{lexer.line_count('content')} AS lines",
        f"{lexer.comment_lines('_skeleton')} AS comment_lines",
        f"{lexer.code_lines('_skeleton')} AS code_lines",
    )
    expressions = {
        "lines": "lines",
        "blank_lines": "lines - comment_lines - code_lines",
        "comment_lines": "comment_lines",
        "code_lines": "code_lines",
        "complexity": lexer.complexity("_code"),
        "todo_count": lexer.todo_count("_notes"),
        "secrets_found": lexer.secret_count("content", "_chunks", "_style"),
    }
    wanted = ", ".join(f"{expressions[c]} AS {c}" for c in COUNTERS if c in counters)
    return counted.selectExpr(
        "path",
        "root",
        f"{language_sql('path', 'content')} AS language",
        f"inline(array(struct({wanted})))",
        "size_bytes",
        "created_at",
        "modified_at",
        *keep,
    )


def language_sizes(files: DataFrame) -> DataFrame:
    """``path, root, language, lines`` only: no lexemes, for shares and rankings."""
    return files.selectExpr(
        "path", "root", f"{language_sql('path', 'content')} AS language", f"{lexer.line_count('content')} AS lines"
    )


def _sums(columns: Sequence[str], of: DataFrame) -> list[Column]:
    return [F.sum(c).alias(c) for c in columns if c in of.columns]


def lang_stats(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """File count and counter sums by language (and optional further keys)."""
    return stats.groupBy(*by, "language").agg(F.count("*").alias("files"), *_sums(COUNTERS, stats))


def lang_summary(stats: DataFrame, sort_by: str = "lines") -> DataFrame:
    """Language rows plus a ``Total`` row (``is_total``), sorted by one of eight keys.

    The total comes from a rollup over the already grouped languages, so the files are
    aggregated once and never expanded. An unknown key sorts by lines.
    """
    langs = lang_stats(stats)
    rolled = langs.rollup("language").agg(
        F.grouping("language").alias("_g"), F.sum("files").alias("files"), *_sums(COUNTERS, langs)
    )
    result = rolled.select(
        F.when(F.col("_g") == 1, F.lit("Total")).otherwise(F.col("language")).alias("language"),
        "files",
        *[c for c in COUNTERS if c in langs.columns],
        (F.col("_g") == 1).alias("is_total"),
    )
    key = sort_by.lower()
    order = [F.asc("language")] if key == "language" else [F.desc(SORT_KEYS.get(key, "lines")), F.asc("language")]
    return result.orderBy(F.asc("is_total"), *order)


def lang_shares(stats: DataFrame, by: Sequence[str] = ("root",)) -> DataFrame:
    """Share of files and lines per language, within ``by`` or (empty) overall."""
    langs = stats.groupBy(*by, "language").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))
    whole = with_totals(langs, by, {"_files": F.sum("files"), "_lines": F.sum("lines")})
    return whole.select(
        *by,
        "language",
        "files",
        scores.percent(F.col("files"), F.col("_files")).alias("files_pct"),
        "lines",
        scores.percent(F.col("lines"), F.col("_lines")).alias("lines_pct"),
    ).orderBy(*by, F.desc("lines"), F.asc("language"))


def dir_stats(stats: DataFrame, by: Sequence[str] = ("root",)) -> DataFrame:
    """Rollup by immediate parent directory."""
    grouped = stats.groupBy(*by, parent_dir(F.col("path")).alias("directory")).agg(
        F.count("*").alias("files"),
        F.sum("lines").alias("lines"),
        F.sum("code_lines").alias("code_lines"),
        F.sum("comment_lines").alias("comment_lines"),
    )
    return grouped.orderBy(*by, "directory")


def totals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Single sums of the given columns; 0 for an empty frame."""
    return df.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in columns])


def cost_estimate(stats: DataFrame, monthly_cost: float = 8000.0) -> DataFrame:
    """Basic cost model over all code lines: one row."""
    total = stats.agg(F.coalesce(F.sum("code_lines"), F.lit(0)).alias("code_lines"))
    parts = scores.cocomo(F.col("code_lines"), monthly_cost)
    return total.select("code_lines", *[value.alias(name) for name, value in parts.items()])


def health_score(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average complexity, densities, a score out of 100, its status, suggestions, and
    the sustainability band; one row, or one per group in ``by``."""
    sums = stats.groupBy(*by).agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("lines"), F.lit(0)).alias("_lines"),
        F.coalesce(F.sum("comment_lines"), F.lit(0)).alias("_comments"),
        F.coalesce(F.sum("blank_lines"), F.lit(0)).alias("_blanks"),
        F.coalesce(F.sum("complexity"), F.lit(0.0)).alias("_complexity"),
    )
    rates = sums.select(
        *by,
        "files",
        scores.ratio(F.col("_complexity"), F.col("files")).alias("avg_complexity"),
        scores.ratio(F.col("_comments"), F.col("_lines")).alias("comment_density"),
        scores.ratio(F.col("_blanks"), F.col("_lines")).alias("blank_density"),
    )
    avg, comments, blanks = F.col("avg_complexity"), F.col("comment_density"), F.col("blank_density")
    over, bare, dense = scores.health_penalties(avg, comments, blanks)
    scored = rates.withColumn("score", F.greatest(F.lit(100.0) - over - bare - dense, F.lit(0.0)))
    advice = F.array_compact(
        F.array(
            F.when(avg > scores.COMPLEXITY_LIMIT, F.format_string(scores.COMPLEXITY_ADVICE, avg)),
            F.when(comments < scores.COMMENT_LIMIT, F.format_string(scores.COMMENT_ADVICE, comments * 100.0)),
            F.when(blanks < scores.BLANK_LIMIT, F.format_string(scores.BLANK_ADVICE, blanks * 100.0)),
        )
    )
    return scored.select(
        "*",
        scores.health_status(F.col("score")).alias("status"),
        advice.alias("suggestions"),
        scores.sustainability_band(avg).alias("sustainability"),
    )
