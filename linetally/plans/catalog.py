"""The registered queries: every operator bound to the supplied tables.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame over whole tables and whole
texts. Ratios are left as doubles; arrays are joined to text so that results compare
across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linetally.functions import scores
from linetally.functions.analysis import rename_suggestion
from linetally.functions.language import comment_style, language_of, shebang_language
from linetally.functions.paths import extension_of
from linetally.operators import (
    analysis,
    artifacts,
    compare,
    duplicates,
    filters,
    history,
    long_files,
    rollups,
    rules,
    search,
    search_index,
    stats,
    structure,
    views,
)
from linetally.operators.incremental import incremental_scan
from linetally.plans import bindings as B
from linetally.sinks import fragments, reports
from linetally.sources import corpus, directory
from linetally.sources.changelog import RECORD, parse_changes, parse_commits, read_log_records
from linetally.sources.corpus import as_corpus

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}

RETURN_PATTERN = r"[a-z]\..\S*|\.$"
GREP_PATTERN = r"(?i)\b(the|les|der)\b.*\d"
INDEXED_PATTERN = r"return f_\d+50\(x\)"
DOC_REGEXES = [r"^src1\d/", "[", r"/fr/.*7\.txt$"]
SKIP_AUTHOR = "#00000001"
AS_OF_EPOCH = 1_700_500_000
POLICY_ROWS = [("code", 6, 2.0, 1, False), ("prose", 120, None, None, True)]
SARIF_RESULT = (
    "ruleId string, level string, message struct<text:string>, "
    "locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>>>>"
)
OPENAPI_PATHS = "map<string,map<string,struct<summary:string>>>"
SARIF_SCHEMA = (
    "runs array<struct<results:array<struct<ruleId:string,level:string,message:struct<text:string>,"
    "locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>>>>>>>>"
)
LANG_JSON_SCHEMA = (
    "language string, files bigint, lines bigint, blank_lines bigint, comment_lines bigint, code_lines bigint, "
    "complexity double, todo_count bigint, secrets_found bigint"
)
LANG_CSV_SCHEMA = "Extension string, Files bigint, Lines bigint, Code bigint, Comments bigint, Blanks bigint"
DIR_CSV_SCHEMA = "Directory string, Files bigint, Lines bigint, Code bigint, Comments bigint"
DETAILS_SCHEMA = "Path string, Extension string, Lines bigint, Code bigint, Comments bigint, Blanks bigint, Complexity string"
OPENAPI_SCHEMA = "openapi string, paths map<string,map<string,struct<summary:string>>>"


def query(fn: Query) -> Query:
    CATALOG[fn.__name__] = fn
    return fn


def _stats(spark: SparkSession, sf_dir: str, *counters: str) -> DataFrame:
    return stats.file_stats(B.all_files(spark, sf_dir), counters or stats.COUNTERS)


def _code_stats(spark: SparkSession, sf_dir: str, *counters: str) -> DataFrame:
    return stats.file_stats(B.code_files(spark, sf_dir), counters or stats.COUNTERS)


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.language_sizes(B.all_files(spark, sf_dir))


# Sources and sinks


@query
def read_corpus(spark, sf_dir):
    where = B.stored(spark, "corpus")
    B.code_files(spark, sf_dir).select("path", "content").write.parquet(where)
    return corpus.read_corpus(spark, where, root="code").select("root", "path", "content", "size_bytes", "valid_utf8")


@query
def read_many(spark, sf_dir):
    places = {}
    for root, files in (("code", B.code_files), ("site", B.page_files), ("prose", B.doc_files)):
        places[root] = B.stored(spark, root)
        files(spark, sf_dir).select("path", "content").write.parquet(places[root])
    files = corpus.read_many(spark, places)
    return files.groupBy("root").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = B.stored(spark, "log")
    B.log_records(spark, sf_dir).write.option("lineSep", RECORD).text(where)
    return read_log_records(spark, where)


@query
def change_log_commits(spark, sf_dir):
    return parse_commits(_log(spark, sf_dir))


@query
def change_log_changes(spark, sf_dir):
    return parse_changes(_log(spark, sf_dir))


@query
def incremental(spark, sf_dir):
    # Earlier statistics of the even documents, marked by a negative secret count; every
    # third of them has an outdated modification time.
    docs = B.doc_files(spark, sf_dir)
    number = F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("bigint")
    earlier = stats.file_stats(docs.filter(number % 2 == 0)).withColumn("secrets_found", F.lit(-1).cast("bigint"))
    stale = F.when(number % 3 == 0, F.timestamp_seconds(F.lit(0))).otherwise(F.col("modified_at"))
    result = incremental_scan(docs, earlier.withColumn("modified_at", stale))
    return result.select("root", "path", "language", "lines", "code_lines", "secrets_found", "size_bytes")


@query
def lang_json_report(spark, sf_dir):
    where = B.stored(spark, "lang-json")
    reports.write_lang_json(_stats(spark, sf_dir), where)
    return spark.read.schema(LANG_JSON_SCHEMA).json(where)


@query
def lang_csv_report(spark, sf_dir):
    where = B.stored(spark, "lang-csv")
    reports.write_lang_csv(_stats(spark, sf_dir, "lines", "blank_lines", "comment_lines", "code_lines"), where)
    return spark.read.option("header", True).schema(LANG_CSV_SCHEMA).csv(where)


@query
def details_csv_report(spark, sf_dir):
    where = B.stored(spark, "details")
    reports.write_details_csv(_stats(spark, sf_dir, "lines", "blank_lines", "comment_lines", "code_lines", "complexity"), where, semicolons=True)
    return spark.read.option("header", True).schema(DETAILS_SCHEMA).csv(where)


@query
def dir_csv_report(spark, sf_dir):
    where = B.stored(spark, "dir-csv")
    reports.write_dir_csv(_stats(spark, sf_dir, "lines", "code_lines", "comment_lines"), where)
    return spark.read.option("header", True).schema(DIR_CSV_SCHEMA).csv(where)


@query
def findings(spark, sf_dir):
    return rules.findings(_stats(spark, sf_dir, "complexity", "secrets_found"))


@query
def sarif_results(spark, sf_dir):
    documents = rules.sarif_documents(rules.findings(_stats(spark, sf_dir, "complexity", "secrets_found")), documents=8)
    parsed = documents.select("root", F.from_json("document", SARIF_SCHEMA).alias("d"))
    rows = parsed.select("root", F.explode(F.col("d.runs")[0]["results"]).alias("r"))
    uri = F.col("r.locations")[0]["physicalLocation"]["artifactLocation"]["uri"]
    return rows.select(
        "root", F.col("r.ruleId").alias("rule_id"), "r.level", F.col("r.message.text").alias("message"), uri.alias("path")
    )


def _document_lines(spark: SparkSession, where: str, entry: str, closing: str) -> DataFrame:
    """The entries of written documents, one in a line, without the commas between them."""
    lines = spark.read.text(where).select("root", F.ltrim("value", F.lit(",")).alias("value"))
    return lines.where(F.col("value").startswith(entry) & (F.col("value") != closing))


@query
def sarif_files(spark, sf_dir):
    where = B.stored(spark, "sarif")
    fragments.write_sarif(rules.findings(_stats(spark, sf_dir, "complexity", "secrets_found")), where, partitions=8)
    found = _document_lines(spark, where, '{"ruleId"', "]}]}").select("root", F.from_json("value", SARIF_RESULT).alias("r"))
    uri = F.col("r.locations")[0]["physicalLocation"]["artifactLocation"]["uri"]
    return found.select("root", F.col("r.ruleId").alias("rule_id"), "r.level", F.col("r.message.text").alias("message"), uri.alias("path"))


@query
def openapi_files(spark, sf_dir):
    where = B.stored(spark, "openapi")
    fragments.write_openapi(artifacts.api_routes(B.artifact_files(spark, sf_dir)), where, partitions=4)
    found = _document_lines(spark, where, '"', "}}").select("root", F.from_json(F.concat(F.lit("{"), "value", F.lit("}")), OPENAPI_PATHS).alias("paths"))
    by_route = found.select("root", F.explode("paths").alias("route", "methods"))
    rows = by_route.select("root", "route", F.explode("methods").alias("method", "op"))
    return rows.select("root", F.lit(artifacts.OPENAPI_VERSION).alias("openapi"), "route", "method", "op.summary")


@query
def block_stats(spark, sf_dir):
    return long_files.block_stats(long_files.split_blocks(B.all_files(spark, sf_dir), 40))


def _folders(spark: SparkSession, sf_dir: str) -> str:
    """The documents as text files, in folders by language and source."""
    where = B.stored(spark, "folders")
    docs = B.table(spark, sf_dir, "documents").select("lang", "source", F.col("text").alias("value"))
    docs.hint("rebalance", "lang", "source").write.partitionBy("lang", "source").text(where)
    return where


def _folder_totals(files: DataFrame) -> DataFrame:
    texts = files.filter(F.col("path").startswith("lang="))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    shown = texts.filter(F.regexp_extract("path", "([^/]*)$", 1).startswith("part-")).groupBy(folder.alias("folder"))
    return shown.agg(F.sum("lines").alias("lines"), F.sum("size_bytes").alias("size_bytes"))


@query
def directory_corpus(spark, sf_dir):
    files = corpus.read_corpus(spark, _folders(spark, sf_dir), "binaryFile", "texts")
    return _folder_totals(filters.with_lines(files))


@query
def directory_blocks(spark, sf_dir):
    blocks = directory.read_blocks(spark, _folders(spark, sf_dir), "texts", block_bytes=50_000)
    return _folder_totals(long_files.block_stats(blocks))


@query
def skipped_files(spark, sf_dir):
    where = _folders(spark, sf_dir)
    skipped = directory.skipped_files(spark, where, max_bytes=0).filter(F.col("path").contains("/part-"))
    return skipped.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "reason").distinct()


# Filters


@query
def exclude_components(spark, sf_dir):
    return filters.exclude_components(B.all_files(spark, sf_dir), ["Brand_7", "de", "3.html"]).select("root", "path")


@query
def filter_ext(spark, sf_dir):
    return filters.filter_ext(B.all_files(spark, sf_dir), ".rs, html").select("root", "path")


@query
def filter_path_regex(spark, sf_dir):
    return filters.filter_path_regex(B.all_files(spark, sf_dir), DOC_REGEXES).select("root", "path")


@query
def min_lines(spark, sf_dir):
    return filters.min_lines(B.all_files(spark, sf_dir), 20).select("root", "path", "lines")


@query
def failures_only(spark, sf_dir):
    kept = filters.failures_only(_stats(spark, sf_dir, "lines", "complexity"), complexity_threshold=3.0, max_lines=100)
    return kept.select("root", "path", "lines", "complexity")


@query
def uncommitted(spark, sf_dir):
    kept = filters.uncommitted(B.all_files(spark, sf_dir), B.low_quality_paths(spark, sf_dir))
    return filters.with_lines(kept).select("root", "path", "lines")


@query
def large_files(spark, sf_dir):
    return filters.large_files(B.all_files(spark, sf_dir), 100).select("root", "path", "lines")


@query
def grep(spark, sf_dir):
    return search.grep(B.all_files(spark, sf_dir), GREP_PATTERN)


@query
def grep_indexed(spark, sf_dir):
    files = B.all_files(spark, sf_dir)
    where = B.stored(spark, "trigrams")
    search_index.write_index(files, where)
    return search_index.grep_indexed(files, spark.read.parquet(where), INDEXED_PATTERN)


@query
def grep_total(spark, sf_dir):
    return search.grep(B.all_files(spark, sf_dir), GREP_PATTERN).agg(F.count("*").alias("hits"))


@query
def drop_small_shares(spark, sf_dir):
    return filters.drop_small_shares(stats.lang_shares(_sizes(spark, sf_dir), by=()), percent=10.0)


# Per-file functions


@query
def language_labels(spark, sf_dir):
    return B.sample_files(spark, sf_dir).select("path", language_of().alias("language"))


@query
def extensions(spark, sf_dir):
    extension = extension_of(F.col("path")).alias("extension")
    return B.sample_files(spark, sf_dir).select("path", extension, comment_style().alias("style"))


@query
def shebang_labels(spark, sf_dir):
    return B.sample_files(spark, sf_dir).select("path", shebang_language().alias("language"))


@query
def line_counts(spark, sf_dir):
    return _stats(spark, sf_dir, "lines", "blank_lines", "comment_lines", "code_lines").select("root", "path", "lines", "blank_lines", "comment_lines", "code_lines")


@query
def complexity(spark, sf_dir):
    return _stats(spark, sf_dir, "complexity").select("root", "path", "complexity")


@query
def todo_count(spark, sf_dir):
    return _stats(spark, sf_dir, "todo_count").select("root", "path", "todo_count")


@query
def secret_count(spark, sf_dir):
    return _stats(spark, sf_dir, "secrets_found").select("root", "path", "secrets_found")


@query
def keyword_complexity(spark, sf_dir):
    return analysis.file_analysis(B.all_files(spark, sf_dir), ["keyword_complexity"])


@query
def functions_count(spark, sf_dir):
    return analysis.file_analysis(B.all_files(spark, sf_dir), ["functions_count"])


@query
def todo_words(spark, sf_dir):
    return analysis.file_analysis(B.all_files(spark, sf_dir), ["todo_words"])


@query
def naming_violations(spark, sf_dir):
    return analysis.naming_violations(B.all_files(spark, sf_dir))


@query
def docstring_count(spark, sf_dir):
    counted = analysis.file_analysis(B.all_files(spark, sf_dir), ["docstrings_count"])
    return counted.filter("docstrings_count > 0")


@query
def typehint_count(spark, sf_dir):
    counted = analysis.file_analysis(B.all_files(spark, sf_dir), ["typehints_count"])
    return counted.filter("typehints_count > 0")


@query
def style_issues(spark, sf_dir):
    return search.style_issues(B.all_files(spark, sf_dir)).na.fill(0, ["line_no"])


@query
def rename_suggestions(spark, sf_dir):
    return analysis.rename_suggestions(analysis.naming_violations(B.code_files(spark, sf_dir)))


@query
def rename_titles(spark, sf_dir):
    # Both conversions over names made of the customers' segments and keys.
    names = B.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "initcap(lower(c_mktsegment)) || '_' || substring(c_mktsegment, 1, 3) || c_custkey || 'aB' AS name"
    )
    return names.select(
        "c_custkey",
        rename_suggestion(F.col("name"), F.lit("snake_case")).alias("snake"),
        rename_suggestion(F.col("name"), F.lit("PascalCase")).alias("pascal"),
    )


@query
def age_buckets(spark, sf_dir):
    as_of = F.timestamp_seconds(F.lit(AS_OF_EPOCH))
    return B.doc_files(spark, sf_dir).select(
        "path",
        scores.age_bucket(F.col("modified_at"), as_of).alias("modified"),
        scores.age_bucket(F.col("created_at"), as_of).alias("created"),
    )


@query
def complexity_bands(spark, sf_dir):
    return views.complexity_bands(_stats(spark, sf_dir, "complexity"))


@query
def cost_estimate(spark, sf_dir):
    total = stats.cost_estimate(_stats(spark, sf_dir, "code_lines"))
    return total.select("code_lines", *[F.round(c, 3).alias(c) for c in ("effort", "months", "people", "cost")])


@query
def coverage_rates(spark, sf_dir):
    files = B.artifact_files(spark, sf_dir).filter(F.col("path").endswith("coverage.xml"))
    return artifacts.coverage_rates(files).select("path", "status", F.round("line_coverage", 6).alias("line_coverage"))


@query
def dependency_counts(spark, sf_dir):
    return artifacts.dependency_counts(B.artifact_files(spark, sf_dir))


@query
def api_routes(spark, sf_dir):
    return artifacts.api_routes(B.artifact_files(spark, sf_dir))


@query
def openapi_operations(spark, sf_dir):
    documents = artifacts.openapi_documents(artifacts.api_routes(B.artifact_files(spark, sf_dir)), documents=4)
    parsed = documents.select("root", F.from_json("document", OPENAPI_SCHEMA).alias("d"))
    by_route = parsed.select("root", "d.openapi", F.explode("d.paths").alias("route", "methods"))
    rows = by_route.select("root", "openapi", "route", F.explode("methods").alias("method", "op"))
    return rows.select("root", "openapi", "route", "method", "op.summary")


# Joins


@query
def compare_corpora(spark, sf_dir):
    return compare.compare_corpora(
        stats.language_sizes(B.doc_files(spark, sf_dir).unionByName(B.page_files(spark, sf_dir))),
        stats.language_sizes(B.code_files(spark, sf_dir).unionByName(B.page_files(spark, sf_dir))),
    )


@query
def hotspot_risk(spark, sf_dir):
    return history.hotspot_risk(history.hotspots(B.changes(spark, sf_dir)), B.code_files(spark, sf_dir))


@query
def dead_code(spark, sf_dir):
    return analysis.dead_code(B.all_files(spark, sf_dir))


@query
def file_report(spark, sf_dir):
    files = B.all_files(spark, sf_dir)
    return compare.file_report(files).drop("created_at", "modified_at")


@query
def check_policy(spark, sf_dir):
    return rules.check_policy(_stats(spark, sf_dir, "lines", "complexity", "todo_count", "secrets_found"), B.policy(spark, POLICY_ROWS))


# Aggregations


@query
def lang_stats(spark, sf_dir):
    return stats.lang_stats(_stats(spark, sf_dir), by=("root",))


@query
def lang_summary(spark, sf_dir):
    return stats.lang_summary(_stats(spark, sf_dir))


@query
def lang_summary_by_todos(spark, sf_dir):
    return stats.lang_summary(_code_stats(spark, sf_dir), sort_by="todos")


@query
def lang_shares(spark, sf_dir):
    return stats.lang_shares(_sizes(spark, sf_dir), by=("root",))


@query
def dir_stats(spark, sf_dir):
    return stats.dir_stats(_stats(spark, sf_dir, "lines", "code_lines", "comment_lines"))


@query
def health_score(spark, sf_dir):
    scored = stats.health_score(_stats(spark, sf_dir, "lines", "blank_lines", "comment_lines", "code_lines", "complexity"), by=("root",))
    return scored.withColumn("suggestions", F.array_join("suggestions", "; ")).withColumn("score", F.round("score", 6))


@query
def project_health(spark, sf_dir):
    scored = stats.health_score(_stats(spark, sf_dir, "lines", "blank_lines", "comment_lines", "code_lines", "complexity"))
    return scored.select(F.round("score", 6).alias("score"), "status", "sustainability")


@query
def hotspots(spark, sf_dir):
    return history.hotspots(B.changes(spark, sf_dir))


@query
def recent_churn(spark, sf_dir):
    commits = B.commits(spark, sf_dir)
    latest = B.latest_commit(spark, sf_dir)
    return history.recent_churn(B.changes(spark, sf_dir), commits, latest)


def _rollups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    where = B.stored(spark, "rollups")
    rollups.write_rollups(B.changes(spark, sf_dir), B.commits(spark, sf_dir), where)
    return spark.read.parquet(f"{where}/touches"), spark.read.parquet(f"{where}/commits")


@query
def rolled_churn(spark, sf_dir):
    touched, _ = _rollups(spark, sf_dir)
    return rollups.rolled_churn(touched, B.changes(spark, sf_dir), B.commits(spark, sf_dir), B.latest_commit(spark, sf_dir))


@query
def rolled_impact(spark, sf_dir):
    impact = rollups.rolled_impact(*_rollups(spark, sf_dir), SKIP_AUTHOR)
    return impact.withColumn("impact_pct", F.round("impact_pct", 9)).na.fill(-1, ["files_changed"])


@query
def contributors(spark, sf_dir):
    return history.contributors(B.commits(spark, sf_dir), SKIP_AUTHOR)


@query
def contributor_impact(spark, sf_dir):
    impact = history.contributor_impact(B.commits(spark, sf_dir), B.changes(spark, sf_dir), SKIP_AUTHOR)
    return impact.withColumn("impact_pct", F.round("impact_pct", 9)).na.fill(-1, ["files_changed"])


@query
def line_ownership(spark, sf_dir):
    return history.line_ownership(B.ownership(spark, sf_dir), SKIP_AUTHOR)


@query
def duplicate_blocks(spark, sf_dir):
    return duplicates.duplicate_blocks(B.all_files(spark, sf_dir), top=None, across_roots=True)


@query
def duplicate_block_ranking(spark, sf_dir):
    keys = duplicates.block_keys(B.all_files(spark, sf_dir))
    return duplicates.repeated_keys(keys, top=10).select("scope", "block_rank", "occurrences")


@query
def duplicate_locations(spark, sf_dir):
    keys = duplicates.block_keys(B.doc_files(spark, sf_dir))
    found = duplicates.duplicate_locations(keys, top=None, locations=5)
    return found.select("root", "occurrences", "location_no", "path", "line_no")


@query
def duplicate_report(spark, sf_dir):
    return duplicates.duplicate_report(B.all_files(spark, sf_dir)).drop("scope")


@query
def binary_corpus(spark, sf_dir):
    # Every fifth page ends in a byte that no UTF-8 text holds.
    pages = B.table(spark, sf_dir, "pages").selectExpr(
        f"{B.PAGE_PATH} AS path", "concat(cast(html AS binary), CASE WHEN page_id % 5 = 0 THEN X'FF' ELSE X'' END) AS content"
    )
    return as_corpus(pages, "site").select("root", "path", "content", "size_bytes", "valid_utf8")


@query
def grep_carriage_returns(spark, sf_dir):
    # Only \n ends a line: $ must not match before \r, and a dot must match it.
    files = B.page_files(spark, sf_dir).withColumn("content", F.replace("content", F.lit("."), F.lit(".\r")))
    return search.grep(files, RETURN_PATTERN).select("root", "path", "line_no")


@query
def analysis_totals(spark, sf_dir):
    measures = ["docstrings_count", "typehints_count", "functions_count", "naming_violations"]
    return stats.totals(analysis.file_analysis(B.all_files(spark, sf_dir), measures), measures)


@query
def style_totals(spark, sf_dir):
    found = search.style_issues(B.all_files(spark, sf_dir))
    return found.groupBy("root", "issue").agg(F.count("*").alias("issues"))


@query
def quality_gate(spark, sf_dir):
    return rules.quality_gate(B.all_files(spark, sf_dir), complexity_threshold=4.0)


# Rankings


@query
def last_author(spark, sf_dir):
    return history.last_author(B.commits(spark, sf_dir), B.changes(spark, sf_dir), SKIP_AUTHOR)


@query
def line_trend(spark, sf_dir):
    return history.line_trend(B.snapshots(spark, sf_dir))


@query
def project_trend(spark, sf_dir):
    return history.project_trend(B.snapshots(spark, sf_dir))


@query
def file_extremes(spark, sf_dir):
    return views.file_extremes(B.all_files(spark, sf_dir), by=("root",))


@query
def top_files(spark, sf_dir):
    # Rank by newlines alone, then take full statistics of the twenty winners.
    longest = views.top_files(B.all_files(spark, sf_dir), 20).drop("lines")
    return views.details(stats.file_stats(longest), F.timestamp_seconds(F.lit(AS_OF_EPOCH)))


@query
def top_complex_files(spark, sf_dir):
    return views.top_complex_files(_stats(spark, sf_dir, "complexity"), 15)


@query
def primary_language(spark, sf_dir):
    return views.top_languages(_sizes(spark, sf_dir), 1)


@query
def top_languages(spark, sf_dir):
    return views.top_languages(_sizes(spark, sf_dir), 5)


# Set operations and structure


@query
def issues(spark, sf_dir):
    files = B.all_files(spark, sf_dir)
    found = rules.issues(stats.file_stats(files, ["lines", "complexity"]), analysis.naming_violations(files), complexity_threshold=3.0, max_lines=100)
    where = B.stored(spark, "issues")
    reports.write_issues_json(found, where)
    return spark.read.schema(found.schema).json(where)


@query
def refactor_candidates(spark, sf_dir):
    return views.refactor_candidates(_stats(spark, sf_dir, "lines", "complexity"), complexity_threshold=3.0, max_lines=100)


@query
def structure_edges(spark, sf_dir):
    return structure.structure_edges(B.all_files(spark, sf_dir))


@query
def tree_listing(spark, sf_dir):
    return structure.tree_listing(B.all_files(spark, sf_dir))
