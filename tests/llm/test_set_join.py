from __future__ import annotations

import random
from itertools import combinations

import brute
import corpus_pipeline
import numpy as np
import pytest
from linetally.llm import set_join
from linetally.operators.places import with_place


def rows_of(df) -> list[tuple]:
    return sorted((r["id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def changed(rng: random.Random, words: list[str], n: int) -> list[str]:
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def corpus(seed: int) -> list[tuple[int, str | None]]:
    """Copies, near copies in chains, sets of all sizes around the boundary, shared passages."""
    rng = random.Random(seed)
    texts: list[str | None] = [None, "", " \n", "one", "One", "one two three", "one two three four"]
    passage = [f"p{i}" for i in range(30)]
    for size in [*range(4, 24), 40, 60, 120, 300]:
        words = [f"w{rng.randrange(500)}" for _ in range(size)]
        texts += [" ".join(words)] * 2
        texts.append(" ".join([*words, "tail"]))
        texts.append(" ".join(words[1:]))
        for n in (1, 2, 4):
            words = changed(rng, words, n)
            texts.append(" ".join(words).upper() if n == 2 else "\t".join(words))
    for i in range(25):
        own = [f"u{i}_{k}" for k in range(rng.randrange(3, 200))]
        texts.append(" ".join(own[: len(own) // 2] + passage + own[len(own) // 2 :]))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "n", 0) for d, t in rows], "doc_id long, text string, node string, id int").repartition(5)
    assert rows_of(set_join.components(docs)) == brute.components(rows)


@pytest.mark.parametrize("boundary", [0, 9, 16])
def test_any_boundary_gives_the_same(spark, monkeypatch, boundary):
    rows = [(d, t) for d, t in corpus(3) if t is None or len(t.split()) < 45]
    monkeypatch.setattr(set_join, "choose_boundary", lambda sizes: boundary)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(set_join.components(docs)) == brute.components(rows)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(150)]
    rows = [(i + 10, " ".join(changed(rng, words, 1))) for i in range(300)] + [(5, " ".join(words)), (900, "other words " * 3)]
    got = rows_of(set_join.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)))
    assert got == brute.components(rows)


def test_nulls_repeats_and_empty_tables(spark):
    schema = "doc_id long, text string"
    rows = [(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (2, "A B C D E"), (7, None), (8, "")]
    got = set_join.components(spark.createDataFrame(rows, schema)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(None, 2, 2), (4, 2, 2), (4, 2, 2), (2, 2, 2), (7, 0, 7), (8, 0, 8)], key=str)
    assert set_join.components(spark.createDataFrame([], schema)).count() == 0
    assert set_join.drop_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_one_of_each_group_stays_with_its_columns(spark):
    rows = [(3, "a b c d e", "x", "k"), (1, "a b c d e", "y", "k"), (1, "a b c d e", "z", "k"), (9, "f g h i j", "x", "k"), (None, "a b c d e", "n", "k"), (5, None, "e", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, maybe string, kept string")
    got = set_join.drop_duplicates(docs)
    assert got.columns == docs.columns
    kept = sorted((r["doc_id"] for r in got.collect()), key=str)
    assert kept == [1, 5, 9, None]


def test_rows_with_places_are_read_where_they_lie(spark, tmp_path):
    rows = [(3, "a b c d e", "x"), (1, "a b c d e", "y"), (1, "a b c d e", "z"), (9, "f g h i j", "x"), (None, "a b c d e", "n"), (None, "a b c d e", "n"), (5, None, "e"), (5, "other words of five", "e")]
    spark.createDataFrame(rows, "doc_id long, text string, id string").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = with_place(spark.read.parquet(str(tmp_path / "docs")))
    got = set_join.drop_duplicates(docs)
    assert got.columns == docs.columns
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert sorted((d for d, _ in kept), key=str) == [1, 5, 9, None, None] and len(set(kept)) == 4
    plain = sorted(((r["doc_id"], r["text"]) for r in set_join.drop_duplicates(docs.drop("place")).collect()), key=str)
    assert plain == sorted(kept, key=str)
    assert set_join.drop_duplicates(docs.limit(0)).count() == 0


def test_sizes_that_fit_and_subsets_that_meet():
    """A pair of small sets lists a subset in common exactly if it links."""
    assert set_join.common_needed(10, 10) == 10 and set_join.common_needed(20, 20) == 19
    rng = random.Random(6)
    universe = rng.sample(range(10**9), 40)
    for _ in range(150):
        n = rng.randrange(1, 17)
        a = set(rng.sample(universe, n))
        b = set(rng.sample(sorted(a), max(0, n - rng.randrange(3)))) | set(rng.sample(universe, rng.randrange(3)))
        if not b or len(b) > 16:
            continue
        keys = [set(set_join.subset_keys(np.array(sorted(x), dtype=np.uint64), 16).tolist()) for x in (a, b)]
        met = {k for k in keys[0] & keys[1] if k % 2 == 0 or len(a) != len(b)}
        assert bool(met) == (100 * len(a & b) >= 85 * len(a | b))
    for n in range(1, 17):
        want = sum(1 for m, c in set_join.fitting_sizes(n) for _ in combinations(range(n), c) if m <= 16)
        assert set_join.subsets_listed(n, 16) == want


def test_boundary_follows_the_cost():
    assert set_join.choose_boundary({5: 1000}) >= 5
    assert set_join.choose_boundary({16: 1000}, entry_cost=0.01) < 16


def test_connected_follows_long_chains(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1002), (1002, 1000)]
    rng = random.Random(1)
    names = {i: rng.getrandbits(62) for i in range(2000)}
    links = spark.createDataFrame([(names[a], names[b]) for a, b in chain], "a long, b long")
    labels = {r["node"]: r["label"] for r in set_join.connected(links).collect()}
    assert len({labels[names[i]] for i in range(201)}) == 1 and len({labels[names[i]] for i in (1000, 1001, 1002)}) == 1
    assert labels[names[0]] != labels[names[1000]] and len(labels) == 204


def all_pairs(rows: list[tuple[int, str | None]], k: int, percent: int) -> list[tuple[int, int, int]]:
    sets = [brute.shingles(t, k) for _, t in rows]
    label = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        union = len(sets[i] | sets[j])
        if union and 100 * len(sets[i] & sets[j]) >= percent * union and label[i] != label[j]:
            old, new = label[i], label[j]
            label = [new if x == old else x for x in label]
    smallest = {x: min(d for (d, _), y in zip(rows, label, strict=True) if x == y) for x in set(label)}
    return sorted((d, len(own), smallest[x]) for (d, _), own, x in zip(rows, sets, label, strict=True))


@pytest.mark.parametrize("k,percent,boundary", [(5, 80, None), (5, 80, 0), (5, 80, 16), (3, 60, None), (1, 100, None)])
def test_other_shingles_and_similarities(spark, monkeypatch, k, percent, boundary):
    rows = corpus(7)
    if boundary is not None:
        rows = [(d, t) for d, t in rows if t is None or len(t.split()) < 45]
        monkeypatch.setattr(set_join, "choose_boundary", lambda sizes, percent: boundary)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(set_join.components(docs, k=k, percent=percent)) == all_pairs(rows, k, percent)


def test_the_pipeline_takes_five_words_and_four_fifths(spark):
    words = [f"w{i}" for i in range(100)]
    two, three = ([f"x{i}" if i in at else w for i, w in enumerate(words)] for at in ((30, 60), (25, 50, 75)))
    assert all_pairs([(1, " ".join(words)), (2, " ".join(two))], 4, 85)[1][2] == 2
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(two)), (3, " ".join(three))], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, "").collect()) == [1, 3]
