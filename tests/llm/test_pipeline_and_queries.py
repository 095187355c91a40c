from __future__ import annotations

import glob
import hashlib

import brute
import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from linetally.llm import bpe, divergence, licences, quality
from linetally.llm.oracle import LICENCES, ORACLE
from linetally.llm.queries import QUERIES, VOCABULARY
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {path.rsplit('/', 1)[1].removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_match_their_twins(spark, tables, name):
    got, want = QUERIES[name](spark, SF), tables.sql(ORACLE[name])
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(str, want.select(*names).fetchall()))


def test_licences_match_their_twin(spark, tables):
    got, want = QUERIES["op6_licences"](spark, SF), tables.sql(LICENCES)
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    rows = [tuple(r[n] for n in names) for r in got.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, want.select(*names).fetchall()))
    assert len({r[names.index("labels")] for r in rows}) > 3


def test_queries_beyond_sql_match_brute_force(spark, documents):
    rows = QUERIES["op2_divergence"](spark, SF).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((r["doc_id"], *[r[n] for n in names]) for r in rows) == sorted((d, *brute.base_quality(t)) for d, t in documents)
    rows = QUERIES["op6_licences"](spark, SF).collect()
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted(((r["doc_id"], *[r[n] for n in names]) for r in rows), key=str) == sorted(((d, *brute.base_licences(t)) for d, t in documents), key=str)
    library = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    ids = {d: library.encode(t or "", add_special_tokens=False).ids for d, t in documents}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op1_bpe"](spark, SF).collect()}
    assert got == {d: (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest()) for d, x in ids.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in QUERIES["op5_token_counts"](spark, SF).collect()} == {d: len(x) for d, x in ids.items()}


def test_pipeline_against_brute_force(spark, documents):
    """The classifier's scores are taken as given; every other stage is done again in plain Python."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scores = {r["id"]: r["score"] for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    rows = [(d, t) for d, t in documents if scores[d] >= 0.5]
    holders: dict[str, set[int]] = {}
    for d, t in rows:
        for line in t.split("\n"):
            holders.setdefault(brute.line_key(line), set()).add(d)
    often = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    rows = [(d, "\n".join(x for x in t.split("\n") if often.get(brute.line_key(x), d) == d)) for d, t in rows]
    heads = {d: c for d, _, c in brute.components(rows, corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)}
    assert (corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT) == (5, 80)
    rows = [(d, t) for d, t in rows if heads[d] == d]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(d, t) for d, t in rows if not brute.contamination(t, items)[-1]]
    library = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    want = sorted((d, library.encode(t, add_special_tokens=False).ids) for d, t in rows)
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids"]
    assert sorted((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got.collect()) == want


def test_the_near_duplicate_stage_is_five_words_and_four_fifths(spark):
    """100 words with two changed: 0.81 of the five-word shingles are shared, but 0.848 of those of four."""
    words = [f"w{i}" for i in range(100)]
    near = ["x" if i in (30, 60) else w for i, w in enumerate(words)]
    far = ["y" if i in (20, 40, 60) else w for i, w in enumerate(words)]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate((words, near, far))], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, SF).collect()) == [0, 2]
    assert len({c for _, _, c in brute.components([(i, " ".join(t)) for i, t in enumerate((words, near, far))])}) == 3


def test_stages_keep_columns_and_bear_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, found string, drop string"
    rows = [(i, t, "en", "s", None, "f", "d") for i, t in enumerate([None, "", "plain words " * 8, "plain words " * 8, "x" * 5000])]
    rows += [(None, "a b c", None, None, 5, None, None), (2, "plain words " * 8, "en", "s", 1, "f", "d")]
    docs = spark.createDataFrame(rows, schema)
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            if name != "bpe":
                assert out.columns == docs.columns, name
            assert out.count() <= frame.count()


def test_distances_and_references_are_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = divergence.references(docs, least_words=1, least_docs=1)
    assert sum(r.classes.sum() for r in found) == sum(len(r["text"]) for r in docs.where("lang is not null").collect())
    assert set(licences.rarity(docs)) == set(licences.vocabulary())
    assert bpe.encode(docs, public_tokenizers.path(VOCABULARY)).count() == docs.count()
