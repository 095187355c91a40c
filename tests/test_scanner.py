from __future__ import annotations

import random

import pytest
from labels import counters

from linetally.operators.stats import COUNTERS, file_stats, lang_stats

FIXTURES = {
    "a/main.rs": (
        '// TODO first\nfn run() {\n\n  if a && b || c { let s = "if // no"; } /* HACK\n\n  end */\n}\n',
        (7, 2, 2, 3, 3.0, 2, 0),
    ),
    "a/util.py": (
        '"""doc\nTODO: x\n"""\ndef BadName(a: int) -> int:  # fixme\n    for i in a:\n        key = "AKIA123"\n    return 1',
        (7, 0, 3, 4, 1.0, 2, 1),
    ),
    "site/p.html": ("<!-- note\n TODO -->\n<p>if ok?</p>\n\n<!-- x -->if\n", (5, 1, 2, 2, 2.0, 1, 0)),
    "conf/x.toml": ('# TODO not a comment here\nk = "v"\n', (2, 0, 0, 2, 0.0, 0, 0)),
    "empty.py": ("", (0, 0, 0, 0, 0.0, 0, 0)),
    "e.js": ("let t = ghp_abc", (1, 0, 0, 1, 0.0, 0, 1)),
    "crlf.c": ("int a;\r\n\r\n/* c\r\n\r\n*/\r\n", (5, 2, 2, 1, 0.0, 0, 0)),
}

FRAGMENTS = (
    ["\n", "\n", " ", "\t", "\r", "\\", '"', "'", "`", '"""', "'''", "//", "/*", "*/", "/", "*", "#", "<!--", "-->", "<", "--", "-", ">"]
    + ["if", "for", "TODO", "fixme", "Hack", "AKIA9", "ghp_x", "xoxb-1", "sk_live_", "x", "else-if", "_", "é", "\u2028", "😀"]
    + ["?", "&", "&&", "|", "||", "&&&", "!", "<!", "a b", "match(", "'''\n", '\\"']
)
EXTENSIONS = {"c": "js", "p": "py", "h": "html", "n": "txt"}


def measured(stats):
    return {r["path"]: tuple(r[c] for c in COUNTERS) for r in stats.collect()}


def test_hand_counted_files(corpus):
    found = measured(file_stats(corpus({p: text for p, (text, _) in FIXTURES.items()})))
    assert found == {p: expected for p, (_, expected) in FIXTURES.items()}


def test_plain_python_account_agrees_with_hand_counts():
    styles = {"rs": "c", "py": "p", "html": "h", "toml": "n", "js": "c", "c": "c"}
    for path, (text, expected) in FIXTURES.items():
        assert counters(text, styles[path.rsplit(".", 1)[1]]) == expected, path


@pytest.mark.parametrize("style", "cphn")
def test_random_text_matches_plain_python(corpus, style):
    rng = random.Random(f"scanner-{style}")
    texts = ["".join(rng.choices(FRAGMENTS, k=rng.randint(0, 40))) for _ in range(4000)]
    files = {f"f{i}.{EXTENSIONS[style]}": text for i, text in enumerate(texts)}
    found = measured(file_stats(corpus(files)))
    wrong = [(text, found[p], counters(text, style)) for p, text in files.items() if found[p] != counters(text, style)]
    assert not wrong, wrong[:3]


def test_very_long_tokens_do_not_overflow_the_matcher(corpus):
    files = {
        "escapes.js": 'x = "' + "\\n" * 200_000 + '"\n',
        "open.py": '"""' + "a\n" * 200_000,
        "stars.c": "/*" + "* " * 200_000 + "*/ if\n",
        "dashes.html": "<!--" + "- " * 200_000 + "--> if\n",
        "code.rs": "a && b; " * 100_000,
    }
    found = measured(file_stats(corpus(files)))
    assert found["escapes.js"] == (1, 0, 0, 1, 0.0, 0, 0)
    assert found["open.py"] == (200_000, 0, 200_000, 0, 0.0, 0, 0)
    assert found["stars.c"] == (1, 0, 0, 1, 1.0, 0, 0)
    assert found["dashes.html"] == (1, 0, 0, 1, 1.0, 0, 0)
    assert found["code.rs"] == (1, 0, 0, 1, 100_000.0, 0, 0)


def test_counters_can_be_selected(corpus):
    stats = file_stats(corpus({p: text for p, (text, _) in FIXTURES.items()}), ["lines", "complexity"])
    assert [c for c in stats.columns if c in COUNTERS] == ["lines", "complexity"]
    assert {r["path"]: (r["lines"], r["complexity"]) for r in stats.collect()} == {
        p: (expected[0], expected[4]) for p, (_, expected) in FIXTURES.items()
    }


def test_invariants_hold_and_do_not_depend_on_partitions(spark):
    from linetally.plans.bindings import code_files

    files = code_files(spark, "/root/testdata/sf0.01")
    stats = file_stats(files).cache()
    assert stats.filter("blank_lines + comment_lines + code_lines <> lines").count() == 0
    by_lang = {r["language"]: r.asDict() for r in lang_stats(stats).collect()}
    expected = {
        "Python": (400, 2800, 400, 400, 2000, 400.0, 800, 40),
        "Rust": (400, 2800, 400, 1200, 1200, 1200.0, 400, 0),
        "JavaScript": (400, 1200, 0, 0, 1200, 400.0, 400, 0),
        "Markdown": (400, 2000, 400, 800, 800, 0.0, 400, 0),
        "TOML": (400, 1200, 0, 0, 1200, 0.0, 0, 0),
    }
    assert {k: tuple(v[c] for c in ["files", *COUNTERS]) for k, v in by_lang.items()} == expected
    spread = {r["language"]: r.asDict() for r in lang_stats(file_stats(files.repartition(13))).collect()}
    assert spread == by_lang
    stats.unpersist()


def test_filters_on_counters_do_not_repeat_the_scan(corpus):
    stats = file_stats(corpus({"a.rs": "if x\n"}))
    plan = stats.filter("complexity >= 1 AND todo_count = 0")._jdf.queryExecution().optimizedPlan().toString()
    conditions = [line for line in plan.splitlines() if "Filter" in line]
    assert conditions and not any("regexp" in line for line in conditions)


def test_exploded_arrays_are_built_once(corpus):
    from linetally.operators import analysis, duplicates, search

    files = corpus({"a.rs": "if x\n"})
    frames = {
        "RLIKE": search.grep(files, "needle"),
        "split(": duplicates.block_keys(files),
        "class\\p": analysis.naming_violations(files),
    }
    for mark, frame in frames.items():
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        conditions = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter")]
        assert mark in plan and conditions and not any(mark in line for line in conditions), mark


def test_filters_on_measures_do_not_repeat_the_analysis(corpus):
    from linetally.operators.analysis import file_analysis

    plan = file_analysis(corpus({"a.rs": "if x\n"})).filter("keyword_complexity > 1")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert not any("regexp" in line for line in text.splitlines() if "Filter" in line)
