from __future__ import annotations

import random
import re
from collections import Counter

import brute
import pytest
from linetally.llm import collocations as C

DOCS = "doc_id long, text string, lang string, w1 string, a int, phrase string, n int"
COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def frame(spark, rows):
    return spark.createDataFrame([(1, t, x, "w", 2, "p", 3) for t, x in rows], DOCS)


def plain(rows, first=2000, least=30):
    counts: dict[str, Counter] = {}
    totals: Counter = Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for m in range(1, 5):
                counts.setdefault(lang, Counter()).update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        displaced = set()
        for g, a in candidates.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    if 100 * a >= 80 * f[g[i : i + m]]:
                        displaced.add(g[i : i + m])
        rows_here = []
        for g, a in candidates.items():
            if g not in displaced:
                score, _, left, right = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                rows_here.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows_here)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def texts(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdeé" for b in "xyz"] + ["The", "of"] * 6
    fixed = [" ".join(rng.sample(vocabulary, rng.randint(2, 7))) for _ in range(12)]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.6 else " ".join(rng.choices(vocabulary, k=rng.randint(0, 6))) for _ in range(rng.randint(0, 8))]
        text = "".join(p + rng.choice([" ", ". ", ",", "\n", "\t", "\v", " !"]) for p in parts)
        rows.append((rng.choice([text, text, text, None, ""]), rng.choice(["en", "en", "en", "fr", None, "und", ""])))
    return rows


@pytest.mark.parametrize(("seed", "first", "least", "most"), [(1, 2000, 5, 1 << 21), (2, 7, 3, 1 << 21), (3, 3, 2, 0), (4, 20, 2, 60)])
def test_random_texts(spark, seed, first, least, most):
    rows = texts(seed)
    found = C.collocations(frame(spark, rows).repartition(5), first, least, most_marks=most)
    assert got(found) == plain(rows, first, least)


def test_rounds_go_down_to_what_is_wanted(spark, monkeypatch):
    """Few pairs score as high as the first bounds, and most of those are displaced."""
    monkeypatch.setattr(C, "ROUNDS", (1, 2))
    rows = texts(9, 100) + [("p q r s t u v", "en")] * 9 + [("one two", "en"), ("two one", "fr")] * 4
    assert got(C.collocations(frame(spark, rows), 12, 4)) == plain(rows, 12, 4)


def test_odd_rows(spark):
    assert got(C.collocations(frame(spark, []))) == []
    assert got(C.collocations(frame(spark, [(None, "en"), ("", None), (" \t.,", "fr")]))) == []
    long = "alpha beta gamma " * 40_000 + "z" * 50_000 + " tail, " + ("k" * 300 + " " + "m" * 300 + " ") * 40
    rows = [(long, "en"), ("the the the the the", "en"), (" ".join(["same"] * 100), None)]
    assert got(C.collocations(frame(spark, rows))) == plain(rows)


def test_scores_beyond_64_bits(spark):
    df = spark.range(1).selectExpr("9000000000000000000 AS a", "9000000000000000001 AS l", "9000000000000000003 AS r")
    assert df.select(C.scored("a", "l", "r")).first()[0] == 2_000_000 * 9000000000000000000 // (9000000000000000001 + 9000000000000000003)
