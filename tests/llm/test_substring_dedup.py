from __future__ import annotations

import hashlib
import random

import brute
import numpy as np
import pytest
from linetally.llm import substring_dedup as S

SCHEMA = "doc_id long, text string, lang string, id long, h string, bucket int, hashes string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", 7, "h", 1, "x") for d, t in rows], SCHEMA)


def judged(rows, k=20):
    """Plain account: the smallest id that holds a window, and where; rows without id stand alone."""
    words = [brute.SPACED.findall(t or "") for _, t in rows]
    smallest = {}
    for (d, _), own in zip(rows, words, strict=True):
        if d is not None:
            for i in range(len(own) - k + 1):
                w = tuple(own[i : i + k])
                smallest[w] = min(d, smallest.get(w, d))
    out = []
    for (d, _), own in zip(rows, words, strict=True):
        gone, seen = set(), set()
        for i in range(len(own) - k + 1):
            w = tuple(own[i : i + k])
            if w in seen or (d is not None and smallest[w] < d):
                gone.update(range(i, i + k))
            seen.add(w)
        kept = " ".join(w for i, w in enumerate(own) if i not in gone)
        out.append((d, len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_polynomials():
    x = np.random.default_rng(1).integers(0, S._PRIME, 90, dtype=np.uint64)
    for k in (1, 2, 3, 5, 20, 31, 90):
        want = [sum(int(x[i + j]) * pow(S._BASE, k - 1 - j, S._PRIME) for j in range(k)) % S._PRIME for i in range(91 - k)]
        assert S.rabin_karp(x, k).tolist() == want
    assert len(S.rabin_karp(x, 91)) == 0
    most = np.full(40, S._PRIME - 1, np.uint64)
    assert len(set(S.rabin_karp(most, 20).tolist())) == 1


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(1, 60))) for _ in range(12)]
    rows = []
    for i in range(60):
        text = rng.choice(["\n", " ", "\té "]).join(rng.sample(pool, rng.randint(0, 4)))
        rows.append((rng.choice([i, i, i, 3, -i, None]), rng.choice([text, text, text, text * 2, None, ""])))
    for k in (20, 3):
        assert got(S.removal_digests(frame(spark, rows).repartition(5), k)) == judged(rows, k)


def test_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    long = " ".join(f"u{i % 9000}" for i in range(200_000))
    rows = [(5, passage), (2, "x " + passage + " y"), (9, passage), (9, passage), (None, passage), (None, passage + " " + passage)]
    rows += [(1, None), (3, ""), (4, " \t\n"), (6, "w1 " * 19), (7, "w1 " * 40), (8, long), (10, "z" * 100_000), (11, "z" * 100_000), (12, "\u0000 " * 30), (-1, " " * 40)]
    assert got(S.removal_digests(frame(spark, rows))) == judged(rows)
    assert got(S.removal_digests(frame(spark, rows).limit(0))) == []
    # Many small partitions and buckets give the same.
    assert got(S.removal_digests(frame(spark, rows).repartition(7), partition_bytes=1000)) == judged(rows)


def test_texts_and_intervals(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(1, "a b " + passage), (2, passage + " c  d\n" + passage + " e"), (3, "f g"), (4, "x " * 3 + passage + " y")]
    assert [tuple(r) for r in S.removal_intervals(frame(spark, rows)).orderBy("id").collect()] == [
        (1, 32, 0, [], []), (2, 63, 60, [0, 32], [30, 62]), (3, 2, 0, [], []), (4, 34, 30, [3], [33])]
    assert [r["text"] for r in S.kept_words(frame(spark, rows)).orderBy("id").collect()] == ["a b " + passage, "c d e", "f g", "x x x y"]


def test_hot_windows_go_once_from_a_batch():
    h = np.repeat(np.arange(5, dtype=np.uint64), 1000)
    ids = np.tile(np.arange(1000), 5)
    first, others = S.combined(ids, h, h << np.uint64(40), 8)
    assert sum(len(x) for x in first.column(1).to_pylist()) == 5
    assert set(sum(first.column(2).to_pylist(), [])) == {0}
    assert sum(len(x) for x in others.column(1).to_pylist()) == 5 * 999
    assert max(others.column(0).to_pylist()) < 0


def test_no_second_exchange_of_windows(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(50))) for i in range(20)]
    plan = S.repeats(frame(spark, rows), partition_bytes=500)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(bucket") == 1
    assert plan.count("Exchange") == 2, plan
