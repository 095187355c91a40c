"""Bands, ages and cost estimates over already aggregated numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Health-score thresholds and penalties.
COMPLEXITY_LIMIT, COMPLEXITY_WEIGHT, COMPLEXITY_CAP = 5.0, 2.0, 30.0
COMMENT_LIMIT, COMMENT_WEIGHT, COMMENT_CAP = 0.1, 200.0, 20.0
BLANK_LIMIT, BLANK_WEIGHT, BLANK_CAP = 0.05, 200.0, 10.0
# Advice that goes with each penalty.
COMPLEXITY_ADVICE = "Average complexity is high (%.1f). Consider refactoring complex functions."
COMMENT_ADVICE = "Comment density is low (%.1f%%). Consider adding more documentation."
BLANK_ADVICE = "Blank line density is low (%.1f%%). Consider adding blank lines to separate logical blocks."


def age_bucket(moment: Column, as_of: Column) -> Column:
    """``42s ago`` … ``7d ago``; ``-`` when unknown or later than ``as_of``."""
    # Units and their bounds.
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp(moment)

    def ago(divisor: int, unit: str) -> Column:
        return F.concat(F.floor(seconds / divisor).cast("string"), F.lit(f"{unit} ago"))

    return (
        F.when(seconds.isNull() | (seconds < 0), F.lit("-"))
        .when(seconds < 60, ago(1, "s"))
        .when(seconds < 3600, ago(60, "m"))
        .when(seconds < 86400, ago(3600, "h"))
        .otherwise(ago(86400, "d"))
    )


def complexity_band(complexity: Column) -> Column:
    # Bands and their marks.
    return (
        F.when(complexity < 2, F.lit(".")).when(complexity < 5, F.lit("o")).when(complexity < 10, F.lit("O")).otherwise(F.lit("@"))
    )


def sustainability_band(average: Column) -> Column:
    # Bands and their colours.
    return F.when(average < 3, F.lit("brightgreen")).when(average < 5, F.lit("yellow")).otherwise(F.lit("red"))


def risk_level(score: Column) -> Column:
    # Bounds of the levels.
    return F.when(score > 50, F.lit("High")).when(score > 20, F.lit("Medium")).otherwise(F.lit("Low"))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as double, 0 when the whole is 0."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * F.lit(100.0)


def health_penalties(avg_complexity: Column, comment_density: Column, blank_density: Column) -> tuple[Column, Column, Column]:
    """The three deductions from 100; each is 0 inside its limit."""
    over = F.least((avg_complexity - COMPLEXITY_LIMIT) * COMPLEXITY_WEIGHT, F.lit(COMPLEXITY_CAP))
    bare = F.least((F.lit(COMMENT_LIMIT) - comment_density) * COMMENT_WEIGHT, F.lit(COMMENT_CAP))
    dense = F.least((F.lit(BLANK_LIMIT) - blank_density) * BLANK_WEIGHT, F.lit(BLANK_CAP))
    zero = F.lit(0.0)
    return (
        F.when(avg_complexity > COMPLEXITY_LIMIT, over).otherwise(zero),
        F.when(comment_density < COMMENT_LIMIT, bare).otherwise(zero),
        F.when(blank_density < BLANK_LIMIT, dense).otherwise(zero),
    )


def health_status(score: Column) -> Column:
    # Grades and their bounds.
    return (
        F.when(score >= 90, F.lit("Excellent"))
        .when(score >= 75, F.lit("Good"))
        .when(score >= 60, F.lit("Fair"))
        .otherwise(F.lit("Needs Improvement"))
    )


def cocomo(code_lines: Column, monthly_cost: float = 8000.0) -> dict[str, Column]:
    """Basic cost model: effort, schedule, people and cost; null without code."""
    # The coefficients of the model.
    effort = F.lit(3.2) * F.pow(code_lines.cast("double") / 1000.0, F.lit(1.05))
    months = F.lit(2.5) * F.pow(effort, F.lit(0.38))
    some = code_lines > 0
    return {
        "effort": F.when(some, effort),
        "months": F.when(some, months),
        "people": F.when(some, effort / months),
        "cost": F.when(some, effort * monthly_cost),
    }


def impact_score(commits: Column, insertions: Column, deletions: Column, files: Column) -> Column:
    """Heuristic: a commit weighs 20, an insertion 1, a deletion 0.5, a file touched 5."""
    # The weights.
    return (commits * 20.0 + insertions * 1.0 + deletions * 0.5 + files * 5.0).cast("double")
