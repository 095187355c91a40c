"""Policies, issues, findings and the quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linetally.functions import analysis as A
from linetally.functions.text import line_count
from linetally.operators.filters import COMPLEXITY_THRESHOLD, LARGE_FILE_LINES
from linetally.operators.rows import emit, explode_once

# Limits that apply where a policy leaves one out.
POLICY_DEFAULTS = {
    "max_lines_per_file": 1000,
    "max_complexity": 20.0,
    "max_todo_count": 50,
    "allow_secrets": False,
}

#: Rules that are broadcast, at most: some MB.
MOST_BROADCAST = 1 << 16

# Finding rules (id, level, name, short description).
FINDING_RULES = [
    ("CS-001", "error", "SecretScanning", "Potential hardcoded secret"),
    ("CS-002", "warning", "HighComplexity", "High Cyclomatic Complexity"),
]
# The complexity that is a finding, and where the document format is described.
FINDING_COMPLEXITY = 15.0
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"


def check_policy(stats: DataFrame, policy: DataFrame) -> DataFrame:
    """``root, path, rule, actual, allowed``: one row per violation; no rows means passed.

    ``policy`` holds one row per root; a second one for a root is an error. A file is
    judged by the rules of its own root, and a root without rules passes. Rules of up to
    ``MOST_BROADCAST`` roots are broadcast (they are counted for that), so statistics are not
    dealt out by root; more are joined like any table.
    """
    rules = policy.groupBy("root").agg(F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in POLICY_DEFAULTS])
    twice = F.raise_error(F.format_string("two policies for root '%s'", "root"))
    once = F.when(F.col("_rows") == 1, F.col("root")).otherwise(twice.cast("string")).alias("root")
    rules = rules.select(once, *[F.coalesce(c, F.lit(d)).alias(c) for c, d in POLICY_DEFAULTS.items()])
    few = policy.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    judged = stats.join(F.broadcast(rules) if few else rules, "root", "inner")

    def rule(name: str, actual: str, allowed: Column) -> Column:
        return F.struct(
            F.lit(name).alias("rule"),
            F.col(actual).cast("double").alias("actual"),
            allowed.cast("double").alias("allowed"),
        )

    over = [("max_lines_per_file", "lines"), ("max_complexity", "complexity"), ("max_todo_count", "todo_count")]
    candidates = [(F.col(actual) > F.col(limit), rule(limit, actual, F.col(limit))) for limit, actual in over]
    leaked = ~F.col("allow_secrets") & (F.col("secrets_found") > 0)
    candidates.append((leaked, rule("allow_secrets", "secrets_found", F.lit(0))))
    return emit(judged, ["root", "path"], candidates)


def issues(
    stats: DataFrame,
    violations: DataFrame,
    complexity_threshold: float = COMPLEXITY_THRESHOLD,
    max_lines: int = LARGE_FILE_LINES,
) -> DataFrame:
    """``root, path, issue_type, description``: large files, complex files, naming violations.

    Issue types and descriptions are fixed texts.
    """
    size = F.format_string(f"File has %d lines (threshold: {max_lines})", "lines")
    tangle = F.format_string(f"Complexity is %.1f (threshold: {complexity_threshold:.1f})", "complexity")
    measured = emit(
        stats,
        ["root", "path"],
        [
            (F.col("lines") > max_lines, F.struct(F.lit("Large File").alias("issue_type"), size.alias("description"))),
            (
                F.col("complexity") >= complexity_threshold,
                F.struct(F.lit("High Complexity").alias("issue_type"), tangle.alias("description")),
            ),
        ],
    )
    named = violations.select(
        "root",
        "path",
        F.lit("Naming Violation").alias("issue_type"),
        F.format_string("%s '%s' in \"%s\" should be %s", "kind", "name", "path", "rule").alias("description"),
    )
    return measured.unionByName(named)


def findings(stats: DataFrame) -> DataFrame:
    """``root, path, rule_id, level, message``: secrets (error) and high complexity (warning).

    The messages are fixed texts.
    """

    def found(rule: int, message: Column) -> Column:
        rule_id, level, _, _ = FINDING_RULES[rule]
        return F.struct(F.lit(rule_id).alias("rule_id"), F.lit(level).alias("level"), message.alias("message"))

    secret = F.format_string("Found %d potential secret(s) (e.g. API keys) in this file.", "secrets_found")
    tangle = F.format_string("High cyclomatic complexity (%.1f). Consider refactoring.", "complexity")
    return emit(
        stats,
        ["root", "path"],
        [
            (F.col("secrets_found") > 0, found(0, secret)),
            (F.col("complexity") > FINDING_COMPLEXITY, found(1, tangle)),
        ],
    )


def sharded(df: DataFrame, by: str, salt: str, shards: int) -> DataFrame:
    """Add ``shard``, a hash of ``salt`` below ``shards``, and deal rows out by group and shard."""
    return df.withColumn("shard", F.pmod(F.xxhash64(salt), F.lit(shards))).repartition(by, "shard")


def sarif_result() -> Column:
    """A finding as the document format has it."""
    return F.struct(
        F.col("rule_id").alias("ruleId"),
        "level",
        F.struct(F.col("message").alias("text")).alias("message"),
        F.array(
            F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation")).alias("physicalLocation"))
        ).alias("locations"),
    )


def sarif_frame(tool: str, results: Column | None = None) -> tuple[list[Column], Column]:
    """``(fields around the runs, one run)``, the run with ``results`` or an empty array."""
    known = F.array(
        *[
            F.struct(
                F.lit(rule_id).alias("id"),
                F.lit(name).alias("name"),
                F.struct(F.lit(text).alias("text")).alias("shortDescription"),
                F.struct(F.lit(level).alias("level")).alias("defaultConfiguration"),
            )
            for rule_id, level, name, text in FINDING_RULES
        ]
    )
    driver = F.struct(F.struct(F.lit(tool).alias("name"), known.alias("rules")).alias("driver")).alias("tool")
    inside = F.array().cast("array<string>") if results is None else results
    return [F.lit(SARIF_VERSION).alias("version"), F.lit(SARIF_SCHEMA).alias("$schema")], F.struct(driver, inside.alias("results"))


def sarif_documents(found: DataFrame, tool: str = "linetally", documents: int = 1) -> DataFrame:
    """SARIF 2.1.0 documents as values: ``root, shard, document``.

    Each root has up to ``documents`` of them, over which its findings are spread by path.
    The number is the caller's and does not depend on the data. For one document of a root
    with more findings than a row should hold, see ``sinks.fragments.write_sarif``.
    """
    grouped = (
        sharded(found, "root", "path", documents)
        .groupBy("root", "shard")
        .agg(F.array_sort(F.collect_list(sarif_result())).alias("results"))
    )
    log, run = sarif_frame(tool, F.col("results"))
    return grouped.select("root", "shard", F.to_json(F.struct(*log, F.array(run).alias("runs"))).alias("document"))


def quality_gate(
    files: DataFrame, complexity_threshold: float = COMPLEXITY_THRESHOLD, max_lines: int = LARGE_FILE_LINES
) -> DataFrame:
    """One row per root: which checks failed, and ``has_issues``.

    The text is read once: every file gives one row of its own checks and one for each
    name that may be an unused function; partial counts are taken before the shuffle.
    """
    content, path = F.col("content"), F.col("path")
    readable = F.col("valid_utf8") if "valid_utf8" in files.columns else F.lit(True)
    own = F.struct(
        (line_count(content) > max_lines).alias("large_file"),
        (readable & (A.keyword_complexity(A.spaced_lines(content)) >= complexity_threshold)).alias("high_complexity"),
        (readable & (F.size(A.naming_violations(path, content)) > 0)).alias("naming_violation"),
    )
    checks = ["large_file", "high_complexity", "naming_violation"]
    def mark(definition: bool):
        nothing = [F.lit(False).alias(c) for c in checks]
        return lambda w: F.struct(w.alias("name"), F.lit(definition).alias("definition"), *nothing)

    def names(of: Column) -> Column:
        return F.when(readable, of).otherwise(F.array().cast("array<string>"))

    itself = F.struct(F.lit(None).cast("string").alias("name"), F.lit(False).alias("definition"), *[own[c].alias(c) for c in checks])
    marks = F.concat(
        F.array(itself),
        F.transform(names(A.identifiers(content)), mark(False)),
        F.transform(names(A.defined_names(path, content)), mark(True)),
    )
    rows = explode_once(files.select("root", marks.alias("marks")), "marks", "mark").select("root", "mark.*")
    per_name = rows.groupBy("root", "name").agg(
        F.sum(F.when(F.col("definition"), 0).otherwise(1)).alias("uses"),
        F.max("definition").alias("defined"),
        *[F.bool_or(c).alias(c) for c in checks],
    )
    unused = F.col("name").isNotNull() & F.col("defined") & (F.col("uses") == 1)
    judged = per_name.groupBy("root").agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in checks], F.bool_or(unused).alias("dead_code"))
    return judged.withColumn("has_issues", F.greatest(*checks, "dead_code"))
