from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from linetally.operators import history, rollups, search, search_index
from linetally.operators.places import with_place
from linetally.sources.corpus import as_corpus
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("pattern", "texts"),
    [
        ("hello", ["hello"]),
        (r"return f_\d+2\(x\)", ["return f_", "2(x)"]),
        (r"abcd?ef\.ghi", ["abc", "ef.ghi"]),
        ("abcd+ef[x]ghi(foo)?jkl", ["abcd", "ghi", "jkl"]),
        ("abcd{0,2}efg", ["abc", "efg"]),
        ("abc|def", []),
        ("(?i)hello", []),
        ("(?:abcd)+efg", ["efg"]),
        ("(abc|d)efg", ["efg"]),
        (r"\x41bcd", []),
        (r"\Qa.b\Ecde", []),
        ("[]abc]def", []),
        ("[a[b]]cde", []),
        ("([)]abc)def", []),
        ("ab*cde", ["cde"]),
        ("^abc$", ["abc"]),
        (r"caf\.é!x", ["caf.é!x"]),
        ("ab", []),
        ("abc{", []),
    ],
)
def test_required_texts(pattern, texts):
    assert search_index.required_texts(pattern) == texts


def test_required_texts_are_in_every_match():
    rng = random.Random(4)
    parts = ["abc", "abcd", "x", "[ab]", "[^c]", "a?", "b*", "c+", "(ab|c)", "(?:bca)", ".", "\\.", "\\w", "{2}", "a{1,2}"]
    checked = 0
    for _ in range(3000):
        pattern = "".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))
        try:
            compiled = re.compile(pattern)
        except re.error:
            continue
        for _ in range(6):
            text = "".join(rng.choice("abcdx.") for _ in range(25))
            hit = compiled.search(text)
            if hit:
                checked += 1
                assert all(t in hit.group() for t in search_index.required_texts(pattern)), (pattern, text)
    assert checked > 1000


def test_indexed_search_finds_the_same_lines(spark, tmp_path):
    rng = random.Random(6)
    words = ["alpha", "beta(x)", "gamma", "deltaé", "fooBar", "a.b.c", ""]
    rows = [(f"f{i}.txt", "\n".join(" ".join(rng.choice(words) for _ in range(4)) for _ in range(rng.randint(0, 5)))) for i in range(200)]
    rows.append(("rare.txt", "one needle here\nand alpha"))
    spark.createDataFrame(rows, "path string, content string").repartition(4).write.parquet(str(tmp_path / "files"))
    files = as_corpus(with_place(spark.read.parquet(str(tmp_path / "files"))), "r")
    search_index.write_index(files, str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    for pattern in ("needle", r"beta\(x\).*gamma", "foo|needle", "al", r"a\.b\.c$", "nothing at all", "deltaé", "alpha beta"):
        got, want = search_index.grep_indexed(files, index, pattern), search.grep(files, pattern)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), pattern
    assert [r["path"] for r in search_index.candidates(index, "needle").collect()] == ["rare.txt"]
    plan = search_index.grep_indexed(files, index, "needle")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    named = search_index.candidates(index, "needle")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in named or "PartitionFilters: [bucket" in named


def test_index_takes_new_files(spark, corpus, tmp_path):
    where = str(tmp_path / "index")
    search_index.write_index(corpus({"a": "needle"}), where)
    search_index.write_index(corpus({"b": "more needles"}), where, mode="append")
    found = search_index.candidates(spark.read.parquet(where), "needle")
    assert sorted(r["path"] for r in found.collect()) == ["a", "b"]


def test_index_rows_are_of_groups_not_of_files(spark, corpus, tmp_path):
    """A trigram that many files share is a row a group, so the table does not grow with files times trigrams."""
    where = str(tmp_path / "index")
    files = corpus({f"f{i:03}": "one needle here\nand alpha" for i in range(400)}).coalesce(1)
    search_index.write_index(files, where)
    index = spark.read.parquet(where)
    assert index.count() <= 25
    assert sorted(r["path"] for r in search_index.candidates(index, "alpha").collect()) == [f"f{i:03}" for i in range(400)]


def test_long_texts_are_looked_at_in_pieces(monkeypatch):
    rng = random.Random(5)
    for step in (3, 4, 7, 50):
        monkeypatch.setattr(search_index, "STEP_CHARS", step)
        texts = ["".join(rng.choice("abé\n\U0001f600") for _ in range(rng.randint(0, 60))) for _ in range(20)]
        group = search_index._Group()
        for i, text in enumerate(texts):
            group.add("r", f"p{i}", text)
        got = {(r["gram"], f) for r in group.rows("0").to_pylist() if r["files"] for f in r["files"]}
        runs = {(t[k : k + 3], i) for i, t in enumerate(texts) for k in range(len(t) - 2) if "\n" not in t[k : k + 3]}
        assert got == {(int(search_index._hashes(search_index._codes(run))[0]), i) for run, i in runs}


@pytest.fixture(scope="module")
def history_rows(spark):
    rng = random.Random(7)
    start = dt.datetime(2024, 1, 1)
    commits = [(f"c{i}", rng.choice(["ann", "bob", None, "cursor bot"]), start + dt.timedelta(minutes=rng.randrange(60 * 24 * 40))) for i in range(300)]
    changes = [(f"c{rng.randrange(320)}", f"p{rng.randrange(25)}", rng.randrange(9), rng.randrange(9)) for _ in range(900)]
    return (
        spark.createDataFrame(commits, "commit_id string, author string, ts timestamp"),
        spark.createDataFrame(changes, "commit_id string, path string, insertions bigint, deletions bigint"),
    )


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_rollups_give_what_history_gives(spark, history_rows, tmp_path):
    commits, changes = history_rows
    where = str(tmp_path / "rollups")
    cut = "ts < '2024-01-20'"
    first = changes.join(commits.where(cut), "commit_id", "left_semi")
    rollups.write_rollups(first, commits.where(cut), where)
    later = commits.where(f"NOT {cut}")  # new days add their own rows
    rollups.write_rollups(changes.join(later, "commit_id", "left_semi"), later, where, mode="append")
    touched, committed = spark.read.parquet(f"{where}/touches"), spark.read.parquet(f"{where}/commits")
    known = changes.join(commits, "commit_id", "left_semi")
    assert rows(rollups.rolled_hotspots(touched)) == rows(history.hotspots(known))
    assert rows(rollups.rolled_impact(touched, committed)) == rows(history.contributor_impact(commits, changes))
    as_of = F.lit(dt.datetime(2024, 2, 9, 13, 7))
    for days in (1, 2, 7, 30, 365):
        assert rows(rollups.rolled_churn(touched, changes, commits, as_of, days)) == rows(history.recent_churn(changes, commits, as_of, days)), days


def test_impact_groups_once(spark, history_rows):
    commits, changes = history_rows
    df = history.contributor_impact(commits, changes)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") + plan.count("ReusedSubquery") >= 1
