"""Change-history statistics over ``commits`` and ``changes``.

    commits(commit_id STRING, author STRING, ts TIMESTAMP)
    changes(commit_id STRING, path STRING, insertions BIGINT, deletions BIGINT)

Every commit counts its own changes (the first commit included). Skew is handled by
aggregating before each shuffle: distinct counts are first reduced per pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linetally.functions import scores
from linetally.functions.text import line_count
from linetally.operators.rows import first_rows
from linetally.operators.stats import file_stats

UNKNOWN_AUTHOR = "Unknown"
SKIPPED_AUTHOR = "cursor"


def _author(skip: str | None) -> tuple[Column, Column]:
    author = F.coalesce(F.col("author"), F.lit(UNKNOWN_AUTHOR))
    keep = ~F.lower(author).contains(skip.lower()) if skip else F.lit(True)
    return author.alias("author"), keep


def counted_authors(df: DataFrame, skip: str | None = SKIPPED_AUTHOR) -> DataFrame:
    """Name missing authors and drop those whose name contains ``skip`` (any case)."""
    author, keep = _author(skip)
    return df.filter(keep).withColumn("author", author)


def hotspots(changes: DataFrame, top: int | None = 15) -> DataFrame:
    """Commits per path, most first."""
    return top_hotspots(changes.groupBy("path").agg(F.count_distinct("commit_id").alias("commits")), top)


def top_hotspots(counted: DataFrame, top: int | None) -> DataFrame:
    return counted if top is None else counted.orderBy(F.desc("commits"), "path").limit(top)


def recent_churn(
    changes: DataFrame, commits: DataFrame, as_of: Column, days: int = 30, top: int | None = 20
) -> DataFrame:
    """``hotspots`` over the commits of the last ``days`` days before ``as_of``."""
    recent = commits.filter(F.col("ts") >= as_of - F.make_dt_interval(F.lit(days))).select("commit_id")
    return hotspots(changes.join(recent, "commit_id", "left_semi"), top)


def hotspot_risk(hot: DataFrame, source: DataFrame, top: int = 15) -> DataFrame:
    """The ``top`` hotspots with file complexity (0 if the file is unknown), score and risk level.

    ``hot`` has ``path, commits``; ``source`` is a corpus or a stored ``file_stats`` table.
    The limit is taken here, so what is broadcast has ``top`` rows whatever is passed, and
    only hot files of a corpus are scanned.
    """
    hot = hot.select("path", "commits").orderBy(F.desc("commits"), "path").limit(top)
    picked = source.join(F.broadcast(hot), "path", "inner")
    known = picked if "complexity" in source.columns else file_stats(picked.select(*source.columns), ["complexity"])
    worst = known.groupBy("path").agg(F.max("complexity").alias("complexity"))
    scored = hot.join(F.broadcast(worst), "path", "left").select(
        "path", "commits", F.coalesce("complexity", F.lit(0.0)).alias("complexity")
    )
    score = F.col("commits") * F.col("complexity")
    return scored.select(
        "*", score.alias("score"), scores.risk_level(score).alias("risk")
    ).orderBy(F.desc("score"), F.desc("commits"), "path")


def contributors(commits: DataFrame, skip: str | None = SKIPPED_AUTHOR) -> DataFrame:
    """Commits per author, most first, and a ``Total`` row."""
    per_author = counted_authors(commits, skip).groupBy("author").agg(F.count("*").alias("commits"))
    rolled = per_author.rollup("author").agg(F.grouping("author").alias("_g"), F.sum("commits").alias("commits"))
    return rolled.select(
        F.when(F.col("_g") == 1, F.lit("Total")).otherwise(F.col("author")).alias("author"),
        F.coalesce("commits", F.lit(0)).alias("commits"),
        (F.col("_g") == 1).alias("is_total"),
    ).orderBy("is_total", F.desc("commits"), "author")


def contributor_impact(commits: DataFrame, changes: DataFrame, skip: str | None = SKIPPED_AUTHOR) -> DataFrame:
    """Commits, insertions, deletions, distinct files, score and share per author; total row."""
    named = counted_authors(commits, skip).select("commit_id", "author")
    touched = changes.join(named, "commit_id", "inner").select("author", "path", "insertions", "deletions")
    return impact_of(touched, named.select("author", F.lit(1).cast("bigint").alias("commits")), skip)


def impact_of(touched: DataFrame, committed: DataFrame, skip: str | None = SKIPPED_AUTHOR) -> DataFrame:
    """The same from ``touched(author, path, insertions, deletions)`` and ``committed(author, commits)``.

    Changes are first reduced to one row per author and path, which settles the distinct
    files without expanding rows and spreads a dominant author over all tasks. Commits
    join that stream as rows of their own, so commits without changes count too. The
    score is linear in the sums, so the total's score is that of the summed authors; the total
    row and the shares read it from the grouped authors, whose shuffle is made once. Files
    have no total (null).
    """
    pairs = (
        counted_authors(touched, skip)
        .groupBy("author", "path")
        .agg(F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"))
    )
    counted = ["commits", "insertions", "deletions", "files_changed"]
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    facts = pairs.select(
        "author", zero.alias("commits"), "insertions", "deletions", one.alias("files_changed")
    ).unionByName(
        counted_authors(committed, skip).select("author", "commits", *[zero.alias(c) for c in counted[1:]])
    )
    per_author = facts.groupBy("author").agg(*[F.sum(c).alias(c) for c in counted])
    score = scores.impact_score(*[F.col(c) for c in counted])
    total = per_author.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in counted])
    whole = total.select(score).scalar()
    rows = per_author.select("author", *counted, score.alias("score"), F.lit(False).alias("is_total"), scores.percent(score, whole).alias("impact_pct"))
    last = total.select(
        F.lit("Total").alias("author"),
        *counted[:3],
        F.lit(None).cast("bigint").alias("files_changed"),
        score.alias("score"),
        F.lit(True).alias("is_total"),
        F.lit(100.0).alias("impact_pct"),
    )
    return rows.unionByName(last).orderBy("is_total", F.desc("score"), "author")


def line_ownership(ownership: DataFrame, skip: str | None = SKIPPED_AUTHOR) -> DataFrame:
    """Lines per author of every path, and one ``Total`` row per path."""
    owned = counted_authors(ownership, skip).groupBy("path", "author").agg(F.sum("lines").alias("lines"))
    path, author = F.col("path"), F.col("author")
    rolled = owned.groupingSets([[path, author], [path]], path, author).agg(
        F.grouping("author").alias("_g"), F.sum("lines").alias("lines")
    )
    return rolled.select(
        "path",
        F.when(F.col("_g") == 1, F.lit("Total")).otherwise(F.col("author")).alias("author"),
        "lines",
        (F.col("_g") == 1).alias("is_total"),
    ).orderBy("path", "is_total", F.desc("lines"), "author")


def last_author(commits: DataFrame, changes: DataFrame, skip: str | None = SKIPPED_AUTHOR) -> DataFrame:
    """Author of the latest change of each path (ties: greater commit id), by path."""
    named = counted_authors(commits, skip).select("commit_id", "author", "ts")
    latest = (
        changes.select("commit_id", "path")
        .join(named, "commit_id", "inner")
        .groupBy("path")
        .agg(F.max_by("author", F.struct("ts", "commit_id")).alias("author"))
    )
    return latest.orderBy("path")


def line_trend(snapshots: DataFrame, limit: int = 5) -> DataFrame:
    """Line counts of each path in its latest ``limit`` commits.

    Counting happens before the shuffle, so file text stays where it was read.
    """
    sized = snapshots.select("path", "ts", "commit_id", line_count(F.col("content")).alias("lines"))
    ranked = first_rows(sized, ["path"], [F.desc("ts"), F.desc("commit_id")], limit, "recency", "commit_id")
    return ranked.select("path", "recency", "ts", "commit_id", "lines")


def project_trend(snapshots: DataFrame, limit: int = 5) -> DataFrame:
    """Total lines over all files of the latest ``limit`` commits."""
    sized = snapshots.select("ts", "commit_id", line_count(F.col("content")).alias("lines"))
    summed = sized.groupBy("ts", "commit_id").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))
    return summed.orderBy(F.desc("ts"), F.desc("commit_id")).limit(limit)
