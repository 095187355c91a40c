from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from linetally.llm import line_index, wu_manber


def text(rng: random.Random, n: int, size: int = 6) -> str:
    return "".join(rng.choice("abc"[: max(1, size // 2)]) * rng.randrange(1, 3) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))


@pytest.mark.parametrize(("seed", "block_bytes"), [(1, 1 << 20), (2, 60), (3, 1)])
def test_search_against_brute_force(spark, seed, block_bytes):
    rng = random.Random(seed)
    items = [(i, text(rng, rng.choice([1, 2, 3, 5, 9, 10, 11, 14]))) for i in range(12)] + [(100, None), (101, "?!"), (5, text(rng, 12)), (None, "zz top")]
    words = [t for _, t in items if t]
    docs = [(0, None), (1, ""), (2, "Zz, TOP"), (2, "zz top zz top")]
    docs += [(i + 3, text(rng, rng.randrange(300)) + rng.choice(words).upper() + text(rng, rng.randrange(3))) for i in range(60)]
    docs.append((99, " x ".join(words) * 40))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = wu_manber.contamination(table, bench, block_bytes=block_bytes).collect()
    known = [("" if i is None else i, t) for i, t in items]
    want = [(d, *brute.contamination(t, known)) for d, t in docs]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_search_keeps_columns_and_drops_rows(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, f"zero {item.upper()} eleven", "a", 1), (2, item.replace("five", "FIVE5"), "b", 2), (None, None, "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string, c0 int")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    kept = wu_manber.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["c0"] for r in kept.collect()) == [2, 3]
    none = bench.limit(0)
    assert wu_manber.drop_contaminated(docs, none).count() == 3
    assert wu_manber.contamination(docs.limit(0), bench).count() == 0


def lines(rng: random.Random) -> list[tuple[int | None, str | None]]:
    pool = [f"a shared line number {i} of them" for i in range(8)] + ["short", "", "  ", "é" * 19, "É" * 20, "x" * 20, "\u00a0" + "y" * 20]
    out: list[tuple[int | None, str | None]] = [(500, None), (501, ""), (502, "\n\n")]
    for d in range(60):
        own = [rng.choice([" ", "", "\t"]) + rng.choice(pool) + rng.choice(["", " ", "\r"]) for _ in range(rng.randrange(6))]
        own = [x.upper() if rng.random() < 0.3 else x for x in own] + [f"only in {d} " * 2] * rng.randrange(3)
        rng.shuffle(own)
        out.append((d, "\n".join(own)))
    return [*out, (7, "a shared line number 1 of them"), (None, "a shared line number 2 of them\nown")]


@pytest.mark.parametrize(("seed", "shard_keys", "bundle_bytes"), [(1, 1 << 16, 1 << 20), (2, 2, 1 << 20), (3, 1, 1)])
def test_lines_against_brute_force(spark, seed, shard_keys, bundle_bytes):
    rows = lines(random.Random(seed))
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, drop string").repartition(4)
    got = line_index.line_digests(docs, shard_keys=shard_keys, bundle_bytes=bundle_bytes).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute.kept_lines(rows)


def test_dedup_keeps_other_columns(spark):
    line = "the very same line of text"
    rows = [(i, f"{line}\nown {i}", "d", i * 10) for i in range(4)] + [(9, None, "n", 90), (8, line, "d", 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, drop string, c1 int")
    got = line_index.dedup_lines(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    kept = {r["doc_id"]: (r["text"], r["drop"], r["c1"]) for r in got.collect()}
    assert kept == {i: (f"own {i}", "d", i * 10) for i in range(4)} | {9: (None, "n", 90), 8: (line, "d", 80)}
    assert line_index.dedup_lines(docs.limit(0)).count() == 0
    assert line_index.dedup_lines(docs.where("doc_id > 8")).collect()[0]["text"] is None


@pytest.mark.parametrize("n", [0, 1, 2, 100, 20_000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    a, b = (rng.integers(0, 2**64, n, dtype=np.uint64) for _ in range(2))
    if n > 2:
        a[1] = a[0]  # equal first halves only
    shard = line_index.Shard.build(a, b, np.arange(n))
    assert sorted(shard.slots(a, b).tolist()) == list(range(n))
    held, keeper = shard.keepers(a, b)
    assert held.all() and keeper.tolist() == list(range(n))
    others = rng.integers(0, 2**64, 1000, dtype=np.uint64)
    assert not shard.keepers(others, others)[0].any()
