"""Change history by day: rollups that are kept, added to, and combined for any range.

A commit has one author and one time, so distinct commits of a day, an author and a path
add up over days. The table of touches holds them, and a second one all commits of each day and author.
A new day adds its own rows. Ranges that begin within a day take that day from the
history itself, and all later days from the rollups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linetally.operators.history import SKIPPED_AUTHOR, impact_of, top_hotspots

TOUCHES = ["day", "author", "path", "commits", "insertions", "deletions"]


def _day(ts: Column) -> Column:
    return F.to_date(ts)


def touches(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """``day, author, path, commits, insertions, deletions``: what each author did to a path in a day."""
    dated = commits.select("commit_id", "author", _day(F.col("ts")).alias("day"))
    per_commit = changes.groupBy("commit_id", "path").agg(F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"))
    return per_commit.join(dated, "commit_id").groupBy("day", "author", "path").agg(F.count("*").alias("commits"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"))


def commit_days(commits: DataFrame) -> DataFrame:
    """``day, author, commits``, those without changes included."""
    return commits.groupBy(_day(F.col("ts")).alias("day"), "author").agg(F.count("*").alias("commits"))


def write_rollups(changes: DataFrame, commits: DataFrame, location: str, mode: str = "errorifexists") -> None:
    """Store both tables, ordered by day, so that a range of days is read from few row groups.

    ``mode="append"`` adds days that are not there yet.
    """
    for name, rows in (("touches", touches(changes, commits)), ("commits", commit_days(commits))):
        rows.repartitionByRange("day", "author").sortWithinPartitions("day", "author").write.mode(mode).parquet(f"{location}/{name}")


def rolled_hotspots(touched: DataFrame, top: int | None = 15) -> DataFrame:
    """``history.hotspots`` from touches."""
    return top_hotspots(touched.groupBy("path").agg(F.sum("commits").alias("commits")), top)


def rolled_churn(touched: DataFrame, changes: DataFrame, commits: DataFrame, as_of: Column, days: int = 30, top: int | None = 20) -> DataFrame:
    """``history.recent_churn``: whole days from touches, the day in which the range begins from the history."""
    since = as_of - F.make_dt_interval(F.lit(days))
    whole = touched.where(F.col("day") > _day(since)).select("path", "commits")
    edge = commits.where((F.col("ts") >= since) & (_day(F.col("ts")) == _day(since))).select("commit_id")
    part = changes.join(edge, "commit_id", "left_semi").select("commit_id", "path").distinct().select("path", F.lit(1).cast("bigint").alias("commits"))
    return top_hotspots(whole.unionByName(part).groupBy("path").agg(F.sum("commits").alias("commits")), top)


def rolled_impact(touched: DataFrame, committed: DataFrame, skip: str | None = SKIPPED_AUTHOR) -> DataFrame:
    """``history.contributor_impact`` from both tables, of the days they are filtered to."""
    return impact_of(touched.select("author", "path", "insertions", "deletions"), committed.select("author", "commits"), skip)
