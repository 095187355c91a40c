from __future__ import annotations

import random
from itertools import permutations

import brute
from linetally.llm import filter_audit as A

DOCS = "doc_id long, text string, lang string, h long, mask string, part string, id int"
COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def frame(spark, rows):
    return spark.createDataFrame([(d, t, x, 1, "m", "p", 2) for d, t, x in rows], DOCS)


def plain(rows, labels):
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, x in labels if d is not None and x == 1}
    facts: dict[str, list] = {}
    for d, t, lang in rows:
        text = t or ""
        words = brute.SPACED.findall(text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": d is not None and any(e is not None and e < d and (u or "") == text for e, u, _ in rows),
        }
        facts.setdefault(lang or "", []).append((fails, d in good, d in toxic))
    out = []
    for part, own in facts.items():
        removed_in_all = dict.fromkeys("ABCDE", 0)
        here = []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[0][f]]
                left = [x for x in left if not x[0][f]]
                failing = sum(x[0][f] for x in own)
                alone = sum(x[0][f] and sum(x[0].values()) == 1 for x in own)
                removed_in_all[f] += len(gone)
                here.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), alone, sum(x[1] for x in gone), sum(x[2] for x in gone), f))
        out += [(*r[:-1], removed_in_all[r[-1]]) for r in here]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string") if not rows else spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, quality int, toxic int, text string")


def test_random_tables(spark):
    rng = random.Random(5)
    pool = ["plain word " * 150, " ".join(f"w{i}" for i in range(250)), "ABC " * 10, "a # b", "", None, " \t\n", "é" * 99 + "É", "Ab" * 3, " ".join(f"W{i}" for i in range(210)) + " 5%"]
    for _ in range(2):
        rows = [(rng.choice([i, i, i, 4, -i, None]), rng.choice(pool), rng.choice(["en", "fr", "", None])) for i in range(80)]
        labels = [(rng.choice([i, None, 4]), rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(60)]
        assert got(A.audit(frame(spark, rows).repartition(6), labelled(spark, labels))) == plain(rows, labels)


def test_empty_tables_and_long_texts(spark):
    labels = labelled(spark, [(1, 1, 1)])
    assert got(A.audit(frame(spark, []), labels)) == []
    rows = [(1, "word " * 300_000, "en"), (2, "x" * 1_000_000, "en"), (3, "x" * 1_000_000, "en")]
    assert got(A.audit(frame(spark, rows), labels)) == plain(rows, [(1, 1, 1)])
    assert got(A.audit(frame(spark, rows), labelled(spark, []))) == plain(rows, [])


def test_hot_copies_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(A, "LEAST_HOT", 5)
    rows = [(i, "one text" if i % 3 else f"text {i // 2}", "en" if i % 2 else None) for i in range(300)]
    assert got(A.audit(frame(spark, rows), labelled(spark, []))) == plain(rows, [])


def test_hash_alone_marks_nothing(spark):
    """Texts of one hash, made equal here, are told apart by the text itself."""
    texts = spark.createDataFrame([(1, "", "a", 7), (2, "", "b", 7), (3, "", "b", 7), (4, "", "c", 7)], "id long, part string, text string, h long")
    repeated = spark.createDataFrame([(7, 4)], "h long, n long")
    assert [r["id"] for r in A.copies(texts, repeated, 4).collect()] == [3]


def test_marking_is_a_left_semi_join(spark):
    texts = spark.createDataFrame([(1, "", "a", 7)], "id long, part string, text string, h long")
    plan = A.copies(texts, spark.createDataFrame([(7, 2)], "h long, n long"), 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan and "Cross" not in plan
