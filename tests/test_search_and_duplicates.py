from __future__ import annotations

import random
from collections import defaultdict

from linetally.operators import duplicates, search
from linetally.operators.places import with_place
from linetally.sources.corpus import as_corpus


def test_grep_counts_matching_lines_and_trims(corpus):
    files = corpus({"a": "  Foo \r\nbar\nfoo foo\n", "b": "x　über　"})
    found = {(r["path"], r["line_no"], r["line"]) for r in search.grep(files, "(?i)foo").collect()}
    assert found == {("a", 1, "Foo"), ("a", 3, "foo foo")}
    assert [r["line"] for r in search.grep(files, r"\b\w{4}\b$|^x").collect()] == ["x　über"]


def test_style_issues(corpus):
    text = "ok\nends \t\n" + "é" * 101 + "\n" + "y" * 100 + "\nlast "
    rows = search.style_issues(corpus({"a": text, "b": "fine\n", "c": ""})).collect()
    assert sorted(((r["line_no"] or 0), r["issue"]) for r in rows) == [
        (0, "Missing newline at end of file"),
        (2, "Trailing whitespace"),
        (3, "Line exceeds 100 characters"),
        (5, "Trailing whitespace"),
    ]
    assert {r["path"] for r in rows} == {"a"}


def brute_force(rows, across=False):
    places = defaultdict(list)
    for root, path, content in rows:
        kept = [(i + 1, line.strip()) for i, line in enumerate(content.split("\n"))]
        kept = [(i, line) for i, line in kept if len(line.encode()) > 3]
        for at in range(len(kept) - 4):
            block = tuple(line for _, line in kept[at : at + 5])
            places["*" if across else root, block].append((path, root, kept[at][0]))
    return {k: sorted(v) for k, v in places.items() if len(v) > 1}


def skewed_rows():
    # One license header sits in a third of all files; other lines come from a small pool.
    rng = random.Random(7)
    header = "\n".join(f"license line {i}" for i in range(6))
    rows = []
    for n in range(150):
        body = "\n".join(rng.choice(["alpha one", "beta two ", "  x", "", "gamma three", "delta"]) for _ in range(12))
        rows.append((f"r{n % 2}", f"f{n:03}.txt", f"{header}\n{body}" if n % 3 == 0 else body))
    return rows


def test_duplicates_match_brute_force(corpus):
    rows = skewed_rows()
    for across in (False, True):
        expected = brute_force(rows, across)
        found = duplicates.duplicate_blocks(corpus(rows), top=None, across_roots=across).collect()
        got = {(r["scope"], tuple(r["preview"].split("\n"))): (r["occurrences"], (r["path"], r["root"], r["line_no"])) for r in found}
        assert got == {k: (len(v), v[0]) for k, v in expected.items()}


def test_top_blocks_and_first_locations(corpus):
    rows = skewed_rows()
    expected = brute_force(rows)
    found = duplicates.duplicate_blocks(corpus(rows), top=3).collect()
    for root in ("r0", "r1"):
        counts = sorted((len(v) for (scope, _), v in expected.items() if scope == root), reverse=True)
        assert sorted((r["occurrences"] for r in found if r["scope"] == root), reverse=True) == counts[:3]
    located = duplicates.duplicate_locations(duplicates.block_keys(corpus(rows)), top=None, locations=5).collect()
    assert len(located) == sum(min(len(v), 5) for v in expected.values())
    everything = duplicates.duplicate_locations(duplicates.block_keys(corpus(rows)), top=None, locations=None)
    assert everything.count() == sum(len(v) for v in expected.values())


def test_line_boundaries_matter_inside_a_block(corpus):
    one = "abcd\nefgh\nijkl\nmnop\nqrst\n"
    other = "abcdefgh\nijkl\nmnop\nqrst\nuvwx\n"
    assert duplicates.duplicate_blocks(corpus({"a": one, "b": other, "c": "abc\n" * 9}), top=None).collect() == []


def test_hot_blocks_are_cut_before_the_shuffle(corpus):
    files = corpus(skewed_rows())
    located = duplicates.duplicate_locations(duplicates.block_keys(files), top=None, locations=5)
    plan = located._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    partial = next(i for i, line in enumerate(lines) if "WindowGroupLimit" in line and "Partial" in line)
    dealt = next(i for i, line in enumerate(lines) if "WindowGroupLimit" in line and "Final" in line)
    assert any("hashpartitioning(scope" in line for line in lines[dealt:partial])
    assert not any("SortMergeJoin" in line for line in lines[partial:partial + 4])


def test_large_roots_are_split_before_they_are_collected(corpus):
    from linetally.operators import rules, stats

    found = rules.findings(stats.file_stats(corpus({f"f{i}.py": "k = 'AKIA1'\n" for i in range(30)})))
    plan = rules.sarif_documents(found, documents=4)._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.splitlines() if "collect_list" in line or "hashpartitioning" in line]
    first_exchange = next(line for line in lines if "hashpartitioning" in line)
    assert "root" in first_exchange and "shard" in first_exchange


def test_previews_do_not_find_the_blocks_again(spark, tmp_path):
    """With places, the text is looked through once for the counts, once for places and once for previews."""
    spark.createDataFrame(skewed_rows(), "root string, path string, content string").write.parquet(str(tmp_path / "t"))
    files = as_corpus(with_place(spark.read.parquet(str(tmp_path / "t"))))
    for top in (None, 3):
        found, want = duplicates.duplicate_blocks(files, top=top), duplicates.duplicate_blocks(files.drop("place"), top=top)
        hashed = [df._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(second") for df in (found, want)]
        assert hashed[0] == 0 and hashed[1] > 0
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    report = duplicates.duplicate_report(files, top=3, locations=2)
    want = duplicates.duplicate_report(files.drop("place"), top=3, locations=2)
    assert sorted(map(tuple, report.collect())) == sorted(map(tuple, want.collect()))
