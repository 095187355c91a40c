from __future__ import annotations

import math
import random
import re
import zlib

import brute
import numpy as np
import pytest
from linetally.llm import quality, toxicity
from linetally.llm.batches import Spans, mixed
from linetally.llm.training import fold, labelled_texts
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def held_out_accuracy(spark, run, label, parts, part):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = run(docs, labels)
    rows = scored.join(labels.select(F.col("doc_id").alias("id"), label), "id").collect()
    assert scored.count() == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["id"]).encode()) % parts == part) for r in rows)
    unseen = [r for r in rows if r["held_out"]]
    good = [r for r in unseen if r[label]]
    bad = [r for r in unseen if not r[label]]
    return (sum(r["predicted"] for r in good) / len(good), sum(1 - r["predicted"] for r in bad) / len(bad))


def test_quality_on_held_out_rows(spark):
    kept, refused = held_out_accuracy(spark, quality.quality_scores, "quality", 3, 1)
    assert kept > 0.98 and refused > 0.95


def test_toxicity_on_held_out_rows(spark):
    caught, left_alone = held_out_accuracy(spark, toxicity.toxicity_scores, "toxic", 5, 0)
    assert caught > 0.8 and left_alone > 0.99


def small(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]

    def sentence(n=12):
        return " ".join(rng.choice(words) for _ in range(n))

    rows, labels = [], []
    for i in range(400):
        own = [sentence() for _ in range(rng.randrange(1, 9))]
        bad = i % 4 == 0
        if bad:
            own.insert(rng.randrange(len(own) + 1), sentence(3) + " vile " + sentence(3))
        rows.append((i, ". ".join(own) + ".", "en"))
        labels.append((i, int(bad)))
    return rows, labels


def test_sentences_that_offend_are_found(spark):
    rows, labels = small(spark)
    extra = [(1000, None, "en"), (1001, "", "en"), (1002, "...\n!?", "en"), (None, "Vile. calm w1 w2.", "en"), (4, "w1 w2", "en")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, score string").repartition(3)
    marks = spark.createDataFrame([*labels, (5, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    weights = toxicity.fit(docs, marks)
    got = {(r["id"], i): r for i, r in enumerate(toxicity.score(docs, weights).collect())}
    for (i, _), r in got.items():
        if i is not None and i < 400 and i != 4:
            assert (r["score"] >= 0.5) == (i % 4 == 0)
            assert len(r["offending"]) == (i % 4 == 0) and all("vile" in s for s in r["offending"])
        if i in (1000, 1001, 1002):
            assert r["score"] == 0 and r["offending"] == []
    assert [r["offending"] for (i, _), r in got.items() if i is None] == [["Vile"]]


def test_noisy_or_of_sentences(spark):
    rows, labels = small(spark)
    weights = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, l string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    texts = ["w1 w2 w3", "w4 vile w5", "w1 w2 w3. w4 vile w5"]
    one, two, both = (r["score"] for r in sorted(toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), weights).collect()))
    assert both == pytest.approx(1 - (1 - one) * (1 - two), abs=1e-6)


def test_quality_edges(spark):
    rows = [(i, "good plain words in a row" if i % 2 else "bad$$$ words$$$ here$$$", "x") for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(7, None), (None, 1)], "doc_id long, quality int")
    more = [(900, None, "x"), (901, "", "x"), (None, "good plain words", "x"), (1, "bad$$$ words$$$", "x")]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string, score string")
    weights = quality.fit(docs, labels)
    assert (quality.fit(docs.repartition(7), labels) == weights).all()  # the order of rows does not matter
    got = quality.score(docs, weights).collect()
    assert all((r["score"] >= 0.5) == bool(r["id"] % 2) for r in got if r["id"] is not None and 1 < r["id"] < 300)
    assert len({r["score"] for r in got if r["id"] in (900, 901)}) == 1
    kept = quality.keep_good(docs, weights)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {None, 1, 3, 5}
    assert quality.keep_good(docs.limit(0), weights).count() == 0
    untrained = quality.quality_scores(docs, labels.limit(0)).collect()
    assert {r["score"] for r in untrained} == {0.5} and {r["predicted"] for r in untrained} == {1}
    untrained = toxicity.toxicity_scores(docs, labels.limit(0).withColumnRenamed("quality", "toxic")).collect()
    assert {r["predicted"] for r in untrained} == {0}


def test_labels_of_the_held_out_part_are_not_read(spark):
    rows = [(i, "good plain words" if i % 2 else "bad$$$ words$$$") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    turned = labels.withColumn("quality", F.when(fold(F.col("doc_id"), 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality.fit(docs, labels) == quality.fit(docs, turned)).all()


def test_what_is_learnt_from_has_a_bound_in_bytes(spark):
    """One very long text, one id with very many rows, and more texts than the bound holds."""
    rows = [(i, "plain words " * 10) for i in range(200)] + [(500, "bad " * 3_000_000)] + [(501, "bad")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(200), 500, 501]], "doc_id long, toxic int")
    ids = lambda **bounds: [r["id"] for r in labelled_texts(docs, labels, "toxic", 5, 9, 8000, most_text_bytes=2000, **bounds).collect()]
    assert sorted(ids()) == list(range(200))
    some = ids(most_bytes=121 * 50)
    assert len(some) == 50 and set(some) < set(range(200))
    assert sorted(ids(most_bytes=121 * 50)) == sorted(some) and ids(most_bytes=0) == []
    assert toxicity.fit(docs, labels).shape == ((1 << toxicity.BITS) + 1,)


def plain_words(text, pattern):
    return re.findall(pattern, brute.lower(text))


def test_scores_against_brute_force(spark):
    """Scores again from the weights, feature by feature, in plain Python."""
    rng = random.Random(3)
    vocabulary = ["Calm", "vile", "x", "w$1", "long-word", "é", "AB", "a1", "same", "same"]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", ". ", "!\n", "  "]) for _ in range(rng.randrange(30))) for _ in range(60)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rnd = np.random.default_rng(4)

    def hashed(word: bytes) -> int:
        one = Spans(np.frombuffer(word, np.uint8))
        return int(one.hashes(np.array([0]), np.array([len(word)]))[0])

    def mix(x: int) -> int:
        return int(mixed(np.array([x & (1 << 64) - 1], np.uint64))[0])

    weights = rnd.normal(size=(1 << toxicity.BITS) + 1).astype(np.float32) / 4
    got = {r["id"]: r["score"] for r in toxicity.score(docs, weights).collect()}
    for i, text in enumerate(texts):
        calm = 1.0
        for sentence in re.split(r"[.!?\n]", text or ""):
            own = [w.encode() for w in plain_words(sentence, r"[0-9a-z\x80-\U0010ffff]+")]
            own = [w for k, w in enumerate(own) if k == 0 or own[k - 1] != w]
            if own:
                keys = [mix(hashed(w)) for w in own] + [mix(hashed(w[:k]) + k) for w in own for k in toxicity.BEGINNINGS]
                z = sum(float(weights[k >> 64 - toxicity.BITS]) for k in keys) + float(weights[-1])
                calm *= 1 - 1 / (1 + math.exp(-z))
        assert got[i] == pytest.approx(1 - calm, abs=1e-5)

    weights = rnd.normal(size=(quality._KINDS << quality.BITS) + 1).astype(np.float32)
    got = {r["id"]: r["score"] for r in quality.score(docs, weights).collect()}
    for i, text in enumerate(texts):
        plain = [w.encode() for w in plain_words(text, r"[^\x20\x09-\x0D]+")]
        raw = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        shape = [re.sub(rb"a+", b"a", re.sub(rb"A+", b"A", re.sub(rb"0+", b"0", re.sub(rb"[a-z\x80-\xff]", b"a", re.sub(rb"[A-Z]", b"A", re.sub(rb"[0-9]", b"0", w)))))) for w in raw]
        shape = [re.sub(rb"(.)\1+", rb"\1", w) for w in shape]
        kinds = [[hashed(w) for w in plain], [int(quality._REPEATED) if k and plain[k - 1] == plain[k] else hashed(w) for k, w in enumerate(shape)]]
        total = 0.0
        for kind, h in enumerate(kinds):
            for k, x in enumerate(h):
                before = h[k - 1] if k else kind + 1
                for column, key in ((2 * kind, mix(x + 2 * kind)), (2 * kind + 1, mix(3 * x + mix(before + 2 * kind + 1)))):
                    total += float(weights[(column << quality.BITS) + (key >> 64 - quality.BITS)])
        z = total * 8 / max(1, 4 * len(plain)) + float(weights[-1])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, z)))), abs=1e-5)
