from __future__ import annotations

import random

import pytest
from linetally.operators import long_files as L
from linetally.operators.stats import COUNTERS, file_stats

TOKENS = ["/*", "*/", "//", '"', "'", "`", '"""', "'''", "#", "<!--", "-->", "-->word", "\\", "\\\"", "\\\n", "\\\r\n", "\n", "\n", "\n\n", "\r\n", "\r", " ", "\t", "if", "x", "-if", "TODO", "todo-x", "fixme", "AKIA1", "xAKIA", "ghp_", "&&", "||", "?", "for ", "/", "<", "&", "é", "case\n", "<!-", "--"]


def counters(df):
    return sorted((r["root"], r["path"], r["language"], *[r[c] for c in COUNTERS], r["size_bytes"]) for r in df.collect())


@pytest.mark.parametrize("lines", [1, 2, 5])
def test_files_cut_anywhere_count_alike(corpus, lines):
    rng = random.Random(lines)
    names = ["a.rs", "b.py", "c.html", "d.txt", "e.md", "run", "f.js", "g.toml"]
    files = corpus([("r", f"{i}/{rng.choice(names)}", "".join(rng.choice(TOKENS) for _ in range(rng.randint(0, 60)))) for i in range(600)] + [("r", "s/run", "#!/usr/bin/env python3\n# TODO\n\nif x:\n")])
    assert counters(L.block_stats(L.split_blocks(files, lines))) == counters(file_stats(files))


def test_runs_compose(corpus, monkeypatch):
    """Several levels of runs give what one gives."""
    monkeypatch.setattr(L, "RUN", 3)
    body = "/* TODO\n\n x */ if a { \"open\n// not a note\n\" }\n" * 9 + "`\n" + "for (;;) {}\n" * 3
    files = corpus({"a.c": body[:-1], "b.c": body[:40], "c.txt": "", "d.py": '"""\n' + body})
    with monkeypatch.context() as m:
        m.setattr(L, "LEVELS", 5)
        assert counters(L.block_stats(L.split_blocks(files, 1))) == counters(file_stats(files))


def test_scans_are_narrow_and_rows_short(corpus):
    blocks = L.split_blocks(corpus({"a.c": "x\n" * 50}), 2)
    text = L.block_stats(blocks)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in text.splitlines() if "Exchange" in line and "content" in line]
