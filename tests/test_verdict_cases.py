"""Cases that the supplied tables do not hold: names, bytes, line ends, logs and plans."""

from __future__ import annotations

import os

import pytest
from linetally.functions.language import language_of
from linetally.functions.paths import parent_dir
from linetally.operators import artifacts, compare, duplicates, filters, history, rules, search, stats, views
from linetally.sources.changelog import parse_changes
from linetally.sources.corpus import as_corpus, read_corpus
from pyspark.sql import functions as F


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_directory_reader_keeps_hidden_names(spark, tmp_path):
    names = ["pkg/__init__.py", "pkg/a.py", "__tests__/t.js", ".github/w.yml", "_config.yml", "deep/er/.x/_y/z"]
    for name in names:
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(b"one\n" if name != "_config.yml" else b"\xff\n")
    rows = {r["path"]: r for r in read_corpus(spark, str(tmp_path), "binaryFile", "r").collect()}
    assert sorted(rows) == sorted(names)
    assert rows["_config.yml"]["valid_utf8"] is False and rows["pkg/a.py"]["valid_utf8"] is True
    assert {r["size_bytes"] for r in rows.values()} == {4, 2} and all(r["modified_at"] for r in rows.values())
    (tmp_path / "none").mkdir()
    assert read_corpus(spark, str(tmp_path / "none"), "binaryFile").count() == 0


def test_binary_content_is_decoded_and_marked(spark):
    rows = spark.createDataFrame([("a", bytearray(b"ok")), ("b", bytearray(b"x\xff")), ("c", None)], "path string, content binary")
    got = {r["path"]: (r["content"], r["size_bytes"], r["valid_utf8"]) for r in as_corpus(rows).collect()}
    assert got == {"a": ("ok", 2, True), "b": ("x\ufffd", 2, False), "c": (None, None, None)}


@pytest.mark.parametrize(
    ("pattern", "line", "hit"),
    [("end$", "end\u0085", False), ("foo$", "foo\r", False), ("x.y", "x\ry", True), ("foo.bar", "foo\u2028bar", True)],
)
def test_only_newline_ends_a_line(corpus, pattern, line, hit):
    files = corpus({"a.txt": f"{line} " if line.endswith("\r") else line})
    if line.endswith("\r"):  # a line's own final \r belongs to its end, so the test puts one inside
        pattern, files = "foo$", corpus({"a.txt": "foo\rx"})
    assert (search.grep(files, pattern).count() == 1) is hit
    assert (filters.filter_path_regex(corpus({line: "x"}), [pattern]).count() == 1) is hit


def test_quoted_names_of_change_logs(spark):
    lines = ["c1\x1fann\x1f5", "", '1\t2\t"src/\\303\\251.rs"', '1\t0\t"a\\tb\\"c\\\\d"', "3\t0\tplain\\name.rs", "-\t-\tb.png"]
    log = spark.createDataFrame([("\n".join(lines),)], "value string")
    rows = sorted((r["path"], r["insertions"], r["deletions"]) for r in parse_changes(log).collect())
    assert rows == [('a\tb"c\\d', 1, 0), ("b.png", 0, 0), ("plain\\name.rs", 3, 0), ("src/é.rs", 1, 2)]


def test_lock_files_that_are_no_json(corpus):
    deep = '{"dependencies":' * 3
    texts = {
        "a/package-lock.json": '{"dependencies":{"a":NaN}}',
        "b/package-lock.json": '{"dependencies":{"a":{}}}',
        "c/package-lock.json": '{"dependencies":{"a":' * 100 + "{}" + "}}" * 100,
        "d/package-lock.json": deep,
    }
    assert {r["path"]: r["dependencies"] for r in artifacts.dependency_counts(corpus(texts)).collect()} == {"b/package-lock.json": 1}


def test_ranking_files_moves_no_text(corpus):
    files = corpus({f"f{i}.rs": "x\n" * i for i in range(9)})
    longest = views.top_files(files, 2)
    assert sorted(r["path"] for r in longest.collect()) == ["f7.rs", "f8.rs"]
    ranking = plan(longest).split("BroadcastExchange")[1]
    assert "TakeOrderedAndProject" in ranking and "Exchange SinglePartition" not in plan(longest)


def test_policy_is_what_is_broadcast(spark, corpus):
    facts = stats.file_stats(corpus([("r", "a.rs", "x\n" * 5), ("s", "b.rs", "x\n" * 5)]))
    schema = "root string, max_lines_per_file bigint, max_complexity double, max_todo_count bigint, allow_secrets boolean"
    policy = spark.createDataFrame([("r", 2, None, None, None)], schema)
    found = rules.check_policy(facts, policy)
    assert [(r["root"], r["rule"]) for r in found.collect()] == [("r", "max_lines_per_file")]
    assert "BuildRight" in plan(found) and "SortMergeJoin" not in plan(found)
    with pytest.raises(Exception, match="two policies for root 'r'"):
        rules.check_policy(facts, policy.union(policy)).collect()


def test_building_these_queries_starts_no_job(spark, corpus):
    files = corpus({"a.py": "def f():\n    return 1\n" * 9, "b.py": "def f():\n    return 1\n" * 9})
    changes = spark.createDataFrame([("c", "a.py", 1, 2)], "commit_id string, path string, insertions bigint, deletions bigint")
    commits = spark.createDataFrame([("c", "ann")], "commit_id string, author string").withColumn("ts", F.timestamp_seconds(F.lit(5)))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "no jobs")
    duplicates.duplicate_report(files)
    duplicates.duplicate_blocks(files, top=None)
    rules.sarif_documents(rules.findings(stats.file_stats(files)), documents=3)
    filters.uncommitted(files, files.select("root", "path"))
    history.contributor_impact(commits, changes)
    history.hotspot_risk(history.hotspots(changes, None), files)
    jobs = tracker.getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not jobs


def test_report_and_gate_read_the_text_once(spark, tmp_path):
    rows = [("main", "a.py", "def f():\n    return 1\n", True), ("main", "b.py", "x\ufffd", False)]
    spark.createDataFrame(rows, "root string, path string, content string, valid_utf8 boolean").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t")).selectExpr("*", "cast(null as timestamp) created_at", "cast(null as timestamp) modified_at", "10L size_bytes")
    report, gate = compare.file_report(table), rules.quality_gate(table)
    assert plan(report).count("FileScan") == 1 and plan(gate).count("FileScan") == 1
    by_path = {r["path"]: r for r in report.collect()}
    assert by_path["a.py"]["functions_count"] == 1 and by_path["a.py"]["has_analysis"]
    assert by_path["b.py"]["functions_count"] is None and not by_path["b.py"]["has_analysis"] and by_path["b.py"]["has_stats"]
    assert gate.collect()[0]["dead_code"] is True


def test_ranks_beyond_the_map_side_limit(corpus):
    block = "\n".join(f"line {i}" for i in range(5)) + "\n"
    files = corpus({f"f{i:04}.txt": block for i in range(40)})
    keys = duplicates.block_keys(files)
    places = duplicates.duplicate_locations(keys, top=2000, locations=1500).collect()
    assert len(places) == 40 and sorted(r["location_no"] for r in places) == list(range(1, 41))


def test_parent_of_a_file_at_the_top(spark):
    paths = spark.createDataFrame([("/a.py",), ("a.py",), ("x/y/a.py",)], "path string")
    assert [r[0] for r in paths.select(parent_dir(F.col("path"))).collect()] == ["/", ".", "x/y"]


#: What every listed extension and name must be called, written out independently of the engine.
EXPECTED_LABELS = """
a.rs Rust|a.py Python|a.pyw Python|a.js JavaScript|a.mjs JavaScript|a.cjs JavaScript|a.ts TypeScript|a.mts TypeScript
a.cts TypeScript|a.jsx JavaScript JSX|a.tsx TypeScript JSX|a.c C|a.h C Header|a.cpp C++|a.cxx C++|a.cc C++
a.hpp C++ Header|a.hxx C++ Header|a.hh C++ Header|a.cs C#|a.java Java|a.go Go|a.rb Ruby|a.php PHP|a.swift Swift
a.kt Kotlin|a.kts Kotlin|a.scala Scala|a.html HTML|a.htm HTML|a.css CSS|a.scss SCSS|a.sass Sass|a.less Less
a.md Markdown|a.markdown Markdown|a.json JSON|a.xml XML|a.yaml YAML|a.yml YAML|a.toml TOML|a.sh Shell|a.bash Shell
a.zsh Shell|a.bat Shell|a.cmd Shell|a.ps1 Shell|a.sql SQL|a.vue Vue|a.svelte Svelte|a.dart Dart|a.r R|a.lua Lua
a.pl Perl|a.pm Perl|a.t Perl|a.txt Text|a.ini INI|a.cfg Config|a.conf Config|a.config Config|a.csv CSV|a.env Dotenv
Makefile Makefile|GNUmakefile Makefile|CMakeLists.txt Makefile|Dockerfile Dockerfile
docker-compose.yml Docker Compose|docker-compose.yaml Docker Compose|LICENSE License|license.txt License
license.md License|Cargo.toml Cargo (Rust)|Cargo.lock Cargo Lock|package.json NPM Package|package-lock.json NPM Lock
yarn.lock Yarn Lock|Gemfile Ruby Gemfile|Gemfile.lock Ruby Gemfile Lock|.gitignore Git Config
.gitattributes Git Config|.gitmodules Git Config|requirements.txt Python Requirements|a.zig Zig|README Unknown
"""


def test_every_listed_label(spark):
    pairs = [x.split(" ", 1) for x in EXPECTED_LABELS.replace("\n", "|").split("|") if x]
    rows = spark.createDataFrame([(name, "") for name, _ in pairs], "path string, content string")
    got = {r["path"]: r["label"] for r in rows.select("path", language_of().alias("label")).collect()}
    assert got == dict(pairs)
