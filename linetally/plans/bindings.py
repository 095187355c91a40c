"""Engine inputs bound to the supplied tables.

The expressions are plain SQL text that Spark and the checking database both read, so
both sides start from the same input rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linetally.operators.places import with_place
from linetally.sources.corpus import as_corpus, union_roots
from linetally.sources.store import new_location as stored  # noqa: F401

# One synthetic source file per part, in five languages.
PART_PATH = (
    "'src/' || replace(p_brand, '#', '_') || '/' || lower(p_type) || '_' || p_partkey || "
    "CASE p_partkey % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.rs' WHEN 2 THEN '.js' WHEN 3 THEN '.md' ELSE '.toml' END"
)
PART_CONTENT = """CASE p_partkey % 5
  WHEN 0 THEN '# TODO ' || p_name || chr(10) || 'def f_' || p_partkey || '(x: int) -> int:' || chr(10) ||
              '    if x:  # fixme ' || chr(10) || '        return f_' || (p_partkey * 2) || '(x)' || chr(10) || chr(10) ||
              'class ' || CASE WHEN p_size % 2 = 0 THEN 'Item' ELSE 'item' END || '_' || p_partkey || ':' || chr(10) ||
              '    key = "' || CASE WHEN p_partkey % 50 = 0 THEN 'AKIA' ELSE 'none' END || p_partkey || '"'
  WHEN 1 THEN '// ' || p_name || chr(10) || 'fn ' || CASE WHEN p_size % 3 = 0 THEN 'doWork' ELSE 'do_work' END || '_' || p_partkey ||
              '(a: u8) {' || chr(10) || '  /* hack' || chr(10) || chr(10) || '  */' || chr(10) ||
              '  if a > 1 && a < ' || p_size || ' || a == 0 { f_' || (p_partkey * 2) || '(); }' || chr(10) || '}' || chr(10)
  WHEN 2 THEN 'function g_' || p_partkey || '(o) {' || chr(10) || '  return o ? "' || p_type || ' // no" : f_' || (p_partkey - 2) || '(o); // TODO' || chr(10) || '}' || chr(10)
  WHEN 3 THEN '# ' || p_name || chr(10) || '<!-- todo' || chr(10) || p_type || ' -->' || chr(10) || chr(10) || 'price ' || p_size || chr(10)
  ELSE '# TODO ' || p_name || chr(10) || 'size = ' || p_size || chr(10) || 'brand = "' || p_brand || '"' || chr(10) END"""
PAGE_PATH = "'site/' || page_id || '.html'"
DOC_PATH = "source || '/' || lang || '/' || doc_id || '.txt'"

# Lock files, coverage reports and route modules, one of each kind per part.
ARTIFACT_KIND = "p_partkey % 6"
ARTIFACT_PATH = (
    f"'app_' || p_partkey || CASE {ARTIFACT_KIND} WHEN 0 THEN '/Cargo.lock' WHEN 1 THEN '/package-lock.json' "
    "WHEN 2 THEN '/package-lock.json' WHEN 3 THEN '/requirements.txt' WHEN 4 THEN '/coverage.xml' ELSE '/routes.py' END"
)
ARTIFACT_CONTENT = f"""CASE {ARTIFACT_KIND}
  WHEN 0 THEN '# ' || p_name || chr(10) || repeat('[[package]]' || chr(10) || 'name = "' || p_type || '"' || chr(10), p_size)
  WHEN 1 THEN CASE WHEN p_size % 7 = 0 THEN '{{"packages": ' ELSE
              '{{"packages": {{"": {{}}, "node_modules/a": {{"version": "' || p_size || '"}}, "node_modules/b": {{}}' ||
              CASE WHEN p_size % 2 = 0 THEN ', "node_modules/c": {{}}' ELSE '' END || '}}}}' END
  WHEN 2 THEN '{{"name": "x", "dependencies": {{"a": {{"version": "1", "dependencies": {{"b": {{"dependencies": {{"d": {{}}}}}}, "c": {{}}}}}}' ||
              CASE WHEN p_size % 2 = 0 THEN ', "e": {{"requires": {{"f": "1"}}}}' ELSE '' END || '}}}}'
  WHEN 3 THEN '# pinned' || chr(10) || chr(10) || repeat('lib==' || p_size || chr(10), p_size % 9) || '  # end'
  WHEN 4 THEN CASE p_size % 3 WHEN 0 THEN '<coverage version="1" line-rate="0.' || p_size || '"></coverage>'
              WHEN 1 THEN '<coverage line-rate="n/a"/>' ELSE '<report/>' END
  ELSE '@app.get("/p/' || (p_partkey % 40) || '")' || chr(10) || '@app.' ||
       CASE p_size % 3 WHEN 0 THEN 'post' WHEN 1 THEN 'put' ELSE 'delete' END || '(''/p/' || (p_partkey % 30) || ''')' || chr(10) ||
       '@app.head("/no")' || chr(10) END"""

# One exported log record per order: a header and two numstat lines, one of them binary.
LOG_RECORD = """o_orderkey || chr(31) || CASE WHEN o_custkey % 10 = 0 THEN '' ELSE 'dev ' || o_custkey END || chr(31) ||
  (1000000000 + o_orderkey * 60) || chr(10) || chr(10) ||
  (o_custkey % 40) || chr(9) || (o_orderkey % 7) || chr(9) || 'src/m' || (o_orderkey % 100) || '.rs' || chr(10) ||
  '-' || chr(9) || '-' || chr(9) || 'img/logo' || (o_orderkey % 9) || '.png' || chr(10) ||
  '3' || chr(9) || '1' || chr(9) || '"docs/caf' || chr(92) || '303' || chr(92) || '251 ' || chr(92) || '"' || (o_orderkey % 5) || chr(92) || '".md"' || chr(10)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with the place of each row, for operators that read listed files only."""
    return with_place(table(spark, sf_dir, name))


def spread(df: DataFrame, key: str = "path") -> DataFrame:
    """Deal out a supplied table that sits in fewer row groups than there are cores.

    Only for these bindings: the small test tables come as single row groups. Corpora that
    users read are never reshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = placed(spark, sf_dir, "part").selectExpr(f"{PART_PATH} AS path", f"{PART_CONTENT} AS content", "place")
    return spread(as_corpus(rows, "code"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = placed(spark, sf_dir, "pages").selectExpr(f"{PAGE_PATH} AS path", "html AS content", "place")
    return spread(as_corpus(rows, "site"))


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = placed(spark, sf_dir, "documents").selectExpr(
        f"{DOC_PATH} AS path",
        "text AS content",
        "place",
        "timestamp_seconds(1700000000 + doc_id * 977) AS modified_at",
        "timestamp_seconds(1690000000 + doc_id) AS created_at",
    )
    return spread(as_corpus(rows, "prose"))


def artifact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr(f"{ARTIFACT_PATH} AS path", f"{ARTIFACT_CONTENT} AS content")
    return as_corpus(rows, "apps")


def all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_roots([code_files(spark, sf_dir), page_files(spark, sf_dir), doc_files(spark, sf_dir)])


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(f"{LOG_RECORD} AS value")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select(
        F.col("o_orderkey").cast("string").alias("commit_id"),
        F.col("c_name").alias("author"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
    )


def latest_commit(spark: SparkSession, sf_dir: str) -> Column:
    """The time of the latest commit, read from the orders alone."""
    return table(spark, sf_dir, "orders").agg(F.max(F.col("o_orderdate").cast("timestamp"))).scalar()


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "part").selectExpr("p_partkey AS l_partkey", f"{PART_PATH} AS path")
    return (
        spread(table(spark, sf_dir, "lineitem"), "l_orderkey")
        .join(paths, "l_partkey", "inner")
        .select(
            F.col("l_orderkey").cast("string").alias("commit_id"),
            "path",
            F.col("l_quantity").cast("bigint").alias("insertions"),
            F.col("l_linenumber").cast("bigint").alias("deletions"),
        )
    )


def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "part").selectExpr("p_partkey AS l_partkey", f"{PART_PATH} AS path")
    names = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS l_suppkey", "s_name AS author")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("lines"))
    return lines.join(paths, "l_partkey", "inner").join(names, "l_suppkey", "left").select("path", "author", "lines")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "cast(turn AS string) AS commit_id",
        "timestamp_seconds(1700000000 + turn * 3600) AS ts",
        "cast(conv_id AS string) AS path",
        "text AS content",
    )


def low_quality_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of documents labelled with quality 0, as a changed-file list."""
    labels = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id")
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{DOC_PATH} AS path")
    return docs.join(labels, "doc_id", "left_semi").select(F.lit("prose").alias("root"), "path")


def policy(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    schema = "root string, max_lines_per_file bigint, max_complexity double, max_todo_count bigint, allow_secrets boolean"
    return spark.createDataFrame(rows, schema)


# File names of every kind of label, dealt out over the parts.
SAMPLE_NAMES = (
    "Makefile|Dockerfile|docker-compose.yml|LICENSE|Cargo.toml|Cargo.lock|package.json|package-lock.json|yarn.lock|"
    "Gemfile|Gemfile.lock|.gitignore|requirements.txt|a.rs|b.PY|c.mjs|d.cts|e.jsx|f.tsx|g.c|h.h|i.cxx|j.hh|k.cs|"
    "l.java|m.go|n.rb|o.php|p.swift|q.kts|r.scala|s.htm|t.css|u.scss|v.sass|w.less|x.markdown|y.json|z.xml|a1.yml|"
    "b1.toml|c1.ps1|d1.sql|e1.vue|f1.svelte|g1.dart|h1.r|i1.lua|j1.pm|k1.txt|l1.ini|m1.conf|n1.csv|o1.env|p1.zig|"
    ".env|trailing.|two.part.Rs|.hidden.tf|run|tool|script|README"
)
SAMPLE_COUNT = len(SAMPLE_NAMES.split("|"))
SAMPLE_PATH = f"'pkg' || p_size || '/' || p_partkey || '/' || split_part('{SAMPLE_NAMES}', '|', cast(1 + p_partkey % {SAMPLE_COUNT} AS int))"
SAMPLE_CONTENT = (
    "CASE p_size % 7 WHEN 0 THEN '#!/usr/bin/env python3' || chr(10) WHEN 1 THEN '#!/usr/bin/node' || chr(10) "
    "WHEN 2 THEN '#!/bin/bash' || chr(10) WHEN 3 THEN '#!/usr/bin/ruby' || chr(10) WHEN 4 THEN '#!/usr/bin/perl -w' "
    "WHEN 5 THEN '#!' || repeat('x', 60) || ' python' ELSE p_name END"
)


def sample_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr(f"{SAMPLE_PATH} AS path", f"{SAMPLE_CONTENT} AS content")
    return as_corpus(rows, "samples")
