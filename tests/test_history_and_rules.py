from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from linetally.operators import compare, history, rules, stats, structure, views
from linetally.plans.bindings import policy

DAY0 = datetime(2024, 1, 1)


@pytest.fixture
def log(spark):
    people = ["Ada", None, "Cursor Bot", "Bob"]
    commits = [(f"c{i}", people[i % 4], DAY0 + timedelta(days=i)) for i in range(40)]
    changes = [(f"c{i}", "hot.rs" if i % 3 == 0 else f"f{i % 5}.rs", i, 1) for i in range(1, 40)]
    changes += [(f"c{i}", "hot.rs", 1, 1) for i in range(0, 40, 3)]
    return (
        spark.createDataFrame(commits, "commit_id string, author string, ts timestamp"),
        spark.createDataFrame(changes, "commit_id string, path string, insertions bigint, deletions bigint"),
    )


def test_hotspots_count_distinct_commits_with_the_first_one(log):
    _, changes = log
    rows = history.hotspots(changes, 2).collect()
    assert (rows[0]["path"], rows[0]["commits"]) == ("hot.rs", 14)
    assert len(rows) == 2


def test_recent_churn_includes_the_cutoff(log):
    commits, changes = log
    as_of = F.lit(DAY0 + timedelta(days=39))
    rows = {r["path"]: r["commits"] for r in history.recent_churn(changes, commits, as_of, days=9).collect()}
    assert rows["hot.rs"] == 4 and sum(rows.values()) == 10


def test_authors(log):
    commits, changes = log
    rows = history.contributors(commits).collect()
    assert [(r["author"], r["commits"], r["is_total"]) for r in rows] == [
        ("Ada", 10, False), ("Bob", 10, False), ("Unknown", 10, False), ("Total", 30, True)
    ]
    impact = {r["author"]: r for r in history.contributor_impact(commits, changes).collect()}
    assert set(impact) == {"Ada", "Bob", "Unknown", "Total"}
    ada = impact["Ada"]
    assert ada["score"] == 20 * 10 + ada["insertions"] + 0.5 * ada["deletions"] + 5 * ada["files_changed"]
    assert abs(sum(r["impact_pct"] for a, r in impact.items() if a != "Total") - 100) < 1e-9
    assert impact["Total"]["files_changed"] is None
    latest = {r["path"]: r["author"] for r in history.last_author(commits, changes).collect()}
    assert latest["hot.rs"] == "Bob"


def test_author_without_changes_still_counts(spark, log):
    commits, changes = log
    quiet = spark.createDataFrame([("z1", "Quiet", DAY0)], commits.schema)
    impact = {r["author"]: r for r in history.contributor_impact(commits.union(quiet), changes).collect()}
    assert (impact["Quiet"]["commits"], impact["Quiet"]["files_changed"], impact["Quiet"]["score"]) == (1, 0, 20.0)


def test_line_ownership(spark):
    owned = spark.createDataFrame([("a", "X", 2), ("a", "X", 3), ("a", None, 9), ("a", "my cursor", 5), ("b", "Y", 1)], "path string, author string, lines bigint")
    rows = [tuple(r) for r in history.line_ownership(owned).collect()]
    assert rows == [("a", "Unknown", 9, False), ("a", "X", 5, False), ("a", "Total", 14, True), ("b", "Y", 1, False), ("b", "Total", 1, True)]


def test_trends(spark):
    shots = spark.createDataFrame(
        [(f"c{i}", DAY0 + timedelta(hours=i), p, "x\n" * (i + k)) for i in range(8) for k, p in enumerate("ab")],
        "commit_id string, ts timestamp, path string, content string",
    )
    rows = [(r["recency"], r["commit_id"], r["lines"]) for r in history.line_trend(shots).filter("path = 'b'").orderBy("recency").collect()]
    assert rows == [(1, "c7", 8), (2, "c6", 7), (3, "c5", 6), (4, "c4", 5), (5, "c3", 4)]
    assert [r["lines"] for r in history.project_trend(shots, 2).collect()] == [15, 13]


def test_hotspot_risk_from_corpus_and_from_table(corpus, log):
    _, changes = log
    files = corpus({"hot.rs": "a && b; if c {}\n", "f1.rs": "x\n", "cold.rs": "if " * 50})
    hot = history.hotspots(changes)
    rows = history.hotspot_risk(hot, files).collect()
    assert [(r["path"], r["score"], r["risk"]) for r in rows][0] == ("hot.rs", 28.0, "Medium")
    assert rows == history.hotspot_risk(hot, stats.file_stats(files)).collect()
    assert "cold.rs" not in {r["path"] for r in rows} and len(rows) == hot.count()


def test_policy_defaults_own_root_and_missing_rules(spark, corpus):
    files = corpus([("a", "x.py", "# todo\n" * 3 + 'k = "ghp_1"'), ("b", "x.py", "if\n" * 30), ("c", "x.py", "if\n" * 5000)])
    rules_table = policy(spark, [("a", 3, None, 2, None), ("b", None, None, None, True)])
    rows = rules.check_policy(stats.file_stats(files), rules_table).collect()
    assert sorted((r["root"], r["rule"], r["actual"], r["allowed"]) for r in rows) == [
        ("a", "allow_secrets", 1.0, 0.0),
        ("a", "max_lines_per_file", 4.0, 3.0),
        ("a", "max_todo_count", 3.0, 2.0),
        ("b", "max_complexity", 30.0, 20.0),
    ]


def test_quality_gate_per_root(corpus):
    files = corpus([("ok", "a.py", "x = 1\n"), ("big", "a.py", "x\n" * 301), ("names", "a.py", "class bad: pass\n"), ("dead", "a.js", "function f() {}\n")])
    rows = {r["root"]: r.asDict() for r in rules.quality_gate(files).collect()}
    assert {k: v["has_issues"] for k, v in rows.items()} == {"ok": False, "big": True, "names": True, "dead": True}
    assert rows["big"]["large_file"] and rows["names"]["naming_violation"] and rows["dead"]["dead_code"]


def test_comparison_with_one_sided_languages(corpus):
    first = stats.file_stats(corpus({"a.rs": "x\n", "b.py": "x\n"}))
    second = stats.file_stats(corpus({"a.rs": "x\ny\n", "c.go": "x\n"}))
    rows = [tuple(r) for r in compare.compare_corpora(first, second).collect()]
    assert rows == [
        ("Go", 0, 1, 1, 0, 1, 1, False),
        ("Python", 1, 0, -1, 1, 0, -1, False),
        ("Rust", 1, 1, 0, 1, 2, 1, False),
        ("Total", 2, 2, 0, 2, 3, 1, True),
    ]


def test_file_report_tells_what_is_missing(corpus):
    files = corpus({"a.py": "def f(): pass\n", "b.py": "x\n"}).withColumn("valid_utf8", F.col("path") == "a.py")
    rows = {r["path"]: r for r in compare.file_report(files, ["a.py", "b.py", "no.py"]).collect()}
    assert {p: (r["has_stats"], r["has_analysis"]) for p, r in rows.items()} == {
        "a.py": (True, True), "b.py": (True, False), "no.py": (False, False)
    }
    assert rows["a.py"]["functions_count"] == 1 and rows["b.py"]["functions_count"] is None


def test_summary_sort_keys_and_shares(corpus):
    files = corpus({"a.rs": "x\ny\n", "b.py": "# todo\n", "c.py": "\n", "d.total": "x\n"})
    table = stats.file_stats(files)
    order = lambda key: [r["language"] for r in stats.lang_summary(table, key).collect()]
    assert order("language") == ["Python", "Rust", "Total", "Total"]
    assert order("files")[0] == "Python" and order("todos")[0] == "Python" and order("nonsense")[:2] == ["Python", "Rust"]
    overall = stats.lang_shares(table, by=()).collect()
    assert abs(sum(r["lines_pct"] for r in overall) - 100) < 1e-9 and abs(sum(r["files_pct"] for r in overall) - 100) < 1e-9
    health = stats.health_score(table).first()
    assert health["status"] == "Excellent" and health["sustainability"] == "brightgreen" and health["suggestions"] == []


def test_health_penalties(corpus):
    worst = stats.health_score(stats.file_stats(corpus({"a.rs": "if " * 100}))).first()
    assert worst["score"] == 40.0 and worst["status"] == "Needs Improvement" and worst["sustainability"] == "red"
    assert worst["suggestions"] == [
        "Average complexity is high (100.0). Consider refactoring complex functions.",
        "Comment density is low (0.0%). Consider adding more documentation.",
        "Blank line density is low (0.0%). Consider adding blank lines to separate logical blocks.",
    ]


def test_rankings(corpus):
    files = corpus({"a.rs": "if x\n" * 3, "b.rs": "x\n" * 9, "c.rs": "x\n"})
    table = stats.file_stats(files)
    assert sorted(r["path"] for r in views.top_files(files, 2).collect()) == ["a.rs", "b.rs"]
    assert [r["path"] for r in views.top_files(table, 2).collect()] == ["b.rs", "a.rs"]
    assert [(r["path"], r["relative"]) for r in views.top_complex_files(table, 2).collect()] == [("a.rs", 1.0), ("b.rs", 0.0)]
    extremes = views.file_extremes(files).first()
    assert (extremes["largest_path"], extremes["smallest_path"]) == ("b.rs", "c.rs")
    assert [r["reasons"] for r in views.refactor_candidates(table, 3, 5).orderBy("path").collect()] == ["High complexity", "High lines"]


def test_structure_reads_no_content(spark, tmp_path):
    rows = [("src/a-b/x.rs", "x"), ("src/y.rs", "y"), ("top.md", "z")]
    spark.createDataFrame(rows, "path string, content string").write.parquet(str(tmp_path / "t"))
    from linetally.sources.corpus import read_corpus

    files = read_corpus(spark, str(tmp_path / "t"), root="r")
    edges = structure.structure_edges(files)
    assert sorted((r["parent"], r["child"], r["kind"]) for r in edges.collect()) == [
        ("root", "src", "directory"),
        ("root", "top.md", "file"),
        ("src", "src/a-b", "directory"),
        ("src", "src/y.rs", "file"),
        ("src/a-b", "src/a-b/x.rs", "file"),
    ]
    assert {r["child_id"] for r in edges.collect()} == {"src", "root_top_md", "src_a_b", "src_y_rs", "src_a_b_x_rs"}
    assert [r["path"] for r in structure.tree_listing(files).collect()] == ["src", "src/a-b", "src/a-b/x.rs", "src/y.rs", "top.md"]
    for frame in (edges, structure.tree_listing(files)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "ReadSchema: struct<path:string>" in plan and "content" not in plan
