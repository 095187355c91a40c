from __future__ import annotations

import random
import re

from linetally.operators import analysis


def one(corpus, path, content):
    return analysis.file_analysis(corpus({path: content})).first()


def plain_keyword_complexity(content):
    """Leftmost, non-overlapping hits of all patterns, line by line."""
    patterns = [" if ", " for ", " while ", " case ", " catch ", " try ", " except ", "&&", "||", "?:", "def ", "function ", "fn "]
    total = 0
    body = content[:-1] if content.endswith("\n") else content
    for line in body.split("\n") if content else []:
        padded, at = f" {line} ".lower(), 0
        while at < len(padded):
            hit = next((p for p in patterns if padded.startswith(p, at)), None)
            total += hit is not None and hit not in ("def ", "function ", "fn ")
            at += len(hit) if hit else 1
    return float(total)


def test_keyword_complexity_matches_plain_python(corpus):
    rng = random.Random(3)
    words = [" ", " ", "if", "for", "IF", "def", "fn", "function", "undef", "case", "try", "&", "&&", "|", "?:", "?", ":", "\n", "x"]
    files = {f"{i}.js": "".join(rng.choices(words, k=rng.randint(0, 30))) for i in range(3000)}
    found = {r["path"]: r["keyword_complexity"] for r in analysis.file_analysis(corpus(files)).collect()}
    wrong = [(t, found[p], plain_keyword_complexity(t)) for p, t in files.items() if found[p] != plain_keyword_complexity(t)]
    assert not wrong, wrong[:3]


def test_counts(corpus):
    row = one(corpus, "a.py", "def f(x: int) -> str:\n    undef y\n    # TODO fixme todos\n\n# note\n\"\"\"doc\"\"\"\n")
    # Hints: ": int", "-> str", and the colon whose white space runs on to "undef".
    assert (row["functions_count"], row["todo_words"], row["docstrings_count"], row["typehints_count"]) == (1, 2, 3, 3)
    row = one(corpus, "a.PY", "def f(x: int):\n# c\n")
    assert (row["functions_count"], row["docstrings_count"], row["typehints_count"]) == (1, 0, 0)


def test_rust_functions_are_definitions_with_a_body(corpus):
    source = (
        "trait T { fn sig(&self) -> u8; }\n"
        "/// fn in_comment() {}\n"
        "fn real<'a>(x: &'a str, y: [u8; 4]) -> char { let s = \"fn text() {}\"; let q = '\"'; 'x' }\n"
        'const R: &str = r#"fn raw() { "q" }"#;\n'
        "impl X { pub fn second(&self) where Self: Sized {\n} }\n"
        "/* fn gone() {} */ type F = fn(u8) -> u8;\n"
    )
    assert one(corpus, "a.rs", source)["functions_count"] == 2


def test_naming_and_renames(corpus):
    files = corpus({"a.py": "def FooBar(): pass\nclass item_one: pass\nclass Good: pass\n", "b.js": "function FooBar() {}\nundef class x\n"})
    rows = analysis.rename_suggestions(analysis.naming_violations(files)).collect()
    assert sorted((r["path"], r["kind"], r["name"], r["suggestion"]) for r in rows) == [
        ("a.py", "Class", "item_one", "ItemOne"),
        ("a.py", "Function", "FooBar", "foo_bar"),
        ("b.js", "Class", "x", "X"),
    ]


def test_dead_code_matches_brute_force(corpus):
    rng = random.Random(11)
    names = [f"n{i}" for i in range(30)] + ["load", "load_all"]
    rows = []
    for i in range(60):
        name = rng.choice(names)
        calls = " ".join(f"{rng.choice(names)}();" for _ in range(rng.randint(0, 2)))
        rows.append((f"r{i % 3}", f"{i}.js", f"function {name}() {{ {calls} }} // hot hot hot"))
    defined = {re.search(r"function (\w+)", c)[1] for _, _, c in rows}
    words = [w for _, _, c in rows for w in re.findall(r"\w+", c)]
    expected = {n for n in defined if words.count(n) == 1}
    assert {r["name"] for r in analysis.dead_code(corpus(rows)).collect()} == expected
    per_root = set()
    for root in ("r0", "r1", "r2"):
        mine = [c for r, _, c in rows if r == root]
        words = [w for c in mine for w in re.findall(r"\w+", c)]
        per_root |= {(root, n) for n in {re.search(r"function (\w+)", c)[1] for c in mine} if words.count(n) == 1}
    assert {(r["root"], r["name"]) for r in analysis.dead_code(corpus(rows), by=("root",)).collect()} == per_root


def test_files_that_are_not_utf8_are_not_analysed(corpus):
    from pyspark.sql import functions as F

    files = corpus({"a.py": "def f(): pass\n", "b.py": "def g(): pass\n"}).withColumn("valid_utf8", F.col("path") == "a.py")
    assert [r["path"] for r in analysis.file_analysis(files).collect()] == ["a.py"]
    assert [r["name"] for r in analysis.dead_code(files).collect()] == ["f"]
