from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from linetally.functions import paths, text
from linetally.functions.language import comment_style, language_of, shebang_language
from linetally.operators import filters


def column(spark, values, expression, name="v"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r["out"] for r in rows.select("i", expression.alias("out")).orderBy("i").collect()]


LINE_CASES = {
    "": [],
    "\n": [""],
    "a": ["a"],
    "a\n": ["a"],
    "a\r\n": ["a"],
    "a\r": ["a\r"],
    "a\n\n": ["a", ""],
    "a\r\nb\r": ["a", "b\r"],
    "\n\n": ["", ""],
    "é b\nc": ["é b", "c"],
    "a\r\r\nb": ["a\r", "b"],
}


def test_lines(spark):
    values = list(LINE_CASES)
    assert column(spark, values, text.lines(F.col("v"))) == list(LINE_CASES.values())
    assert column(spark, values, text.line_count(F.col("v"))) == [len(v) for v in LINE_CASES.values()]


def test_trim_removes_unicode_white_space(spark):
    values = ["  a b\t", " x　", "​x", "", "\r\n  ", "x\u0085"]
    assert column(spark, values, text.utrim(F.col("v"))) == [v.strip(text.WHITE_SPACE) for v in values]


def test_paths(spark):
    values = ["a/b/c.rs", "c.rs", ".env", "a.", "d/.hidden.tf", "x/Makefile", "two.part.Rs", "..x"]
    col = F.col("v")
    assert column(spark, values, paths.extension_of(col)) == ["rs", "rs", None, "", "tf", None, "Rs", "x"]
    assert column(spark, values, paths.parent_dir(col)) == ["a/b", ".", ".", ".", "d", "x", ".", "."]
    assert column(spark, ["a\\b\\c.rs"], paths.normalise(col)) == ["a/b/c.rs"]


@pytest.mark.parametrize(
    ("path", "content", "language", "style"),
    [
        ("src/Makefile", "", "Makefile", "n"),
        ("CMakeLists.txt", "", "Makefile", "n"),
        ("a/Cargo.TOML", "", "Cargo (Rust)", "n"),
        ("a/x.RS", "", "Rust", "c"),
        ("a/x.lua", "", "Lua", "n"),
        ("a/x.zig", "", "Zig", "n"),
        ("a/x.", "#!/bin/sh\n", "Unknown", "n"),
        ("bin/run", "#!/usr/bin/env python3\nx", "Python", "n"),
        ("bin/run", "#!/usr/bin/env zsh", "Shell", "n"),
        ("bin/run", "#!" + "x" * 70 + "python", "Unknown", "n"),
        ("bin/run", "", "Unknown", "n"),
        (".env", "", "Unknown", "n"),
        ("a.env", "", "Dotenv", "n"),
        ("a/x.mjs", "", "JavaScript", "n"),
        ("a/x.Vue", "", "Vue", "h"),
        ("a/x.yml", "", "YAML", "p"),
    ],
)
def test_labels(corpus, path, content, language, style):
    row = corpus({path: content}).select(language_of().alias("l"), comment_style().alias("s")).first()
    assert (row["l"], row["s"]) == (language, style)


def test_shebang_needs_the_first_two_bytes(corpus):
    rows = corpus({"a": " #!/bin/sh", "b": "#!/opt/ruby"}).select("path", shebang_language().alias("l")).collect()
    assert {r["path"]: r["l"] for r in rows} == {"a": None, "b": "Ruby"}


def kept(df):
    return sorted(r["path"] for r in df.select("path").collect())


def test_path_filters(corpus):
    files = corpus({"a/.git/x": "", "target/b.rs": "", "src/target.rs": "", "src/c.RS": "", "Makefile": "", "d.py": ""})
    assert kept(filters.exclude_components(files)) == ["Makefile", "d.py", "src/c.RS", "src/target.rs", "target/b.rs"]
    assert kept(filters.exclude_components(files, ["target"])) == ["Makefile", "d.py", "src/c.RS", "src/target.rs"]
    assert kept(filters.filter_ext(files, [".rs", "py"])) == ["d.py", "src/target.rs", "target/b.rs"]
    assert kept(filters.filter_ext(files, "py , RS")) == ["d.py", "src/c.RS"]
    assert kept(filters.filter_path_regex(files, ["(", "^src/"])) == ["src/c.RS", "src/target.rs"]
    assert len(kept(filters.filter_path_regex(files, ["("]))) == 6


def test_size_filters_use_boundaries(corpus):
    files = corpus({"a": "x\n" * 300, "b": "x\n" * 301})
    assert kept(filters.large_files(files)) == ["b"]
    assert kept(filters.min_lines(files, 300)) == ["a", "b"]


def test_uncommitted_compares_root_and_path(spark, corpus):
    files = corpus([("r1", "a.rs", "x"), ("r1", "ba.rs", "x"), ("r2", "a.rs", "x")])
    changed = spark.createDataFrame([("r1", "a.rs")], "root string, path string")
    assert [(r["root"], r["path"]) for r in filters.uncommitted(files, changed).collect()] == [("r1", "a.rs")]


def test_filtered_semi_join_keeps_the_listed_rows_and_moves_no_others(spark):
    from linetally.operators.rows import semi_join_filtered

    big = spark.range(1000).selectExpr("id AS k", "repeat('x', 10) AS content")
    keys = spark.range(0, 1000, 3).selectExpr("id AS k").union(spark.createDataFrame([(None,)], "k long"))
    kept = semi_join_filtered(big, keys, ["k"])
    assert kept.columns == ["k", "content"]
    assert sorted(r["k"] for r in kept.collect()) == list(range(0, 1000, 3))
    assert semi_join_filtered(big, keys.limit(0), ["k"]).count() == 0
