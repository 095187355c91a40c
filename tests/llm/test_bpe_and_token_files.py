from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from linetally.llm import bpe, token_files
from linetally.llm.batches import slices
from linetally.llm.bpe import Encoder, Vocabulary, vocabulary_source
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None,
    "",
    " \n\t",
    "Hello's world!! 123 ΣΑΣ İstanbul ﬁ é é <|endoftext|> A<|startoftext|>b",
    "日本語 テスト　x\x85y\x1cz​",
    "a" * 500 + " " + "!" * 999 + " " + "ab" * 300,
    "½²Ⅷ x_y __ 'S 'll I'LL don't we're",
    "\x00\x01 ok � ẞ ǅ ŉ K",
    "plain plain plain words and more words",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(vocabulary_source(PATH))


def test_digests_match_the_library(spark, library):
    rng = random.Random(5)
    alphabet = "abcdefghijk ABC éÉñßüΣσς'!?.,123 \n\t|#-_"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(400))) for _ in range(120)]
    # two rows of one id, one without, and columns whose names the operator uses itself
    rows = [(i if i != 8 else None, t, "x", 1) for i, t in enumerate(texts)] + [(3, texts[3], "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, n_tokens int")
    got = sorted((tuple(r) for r in bpe.round_trip_digests(docs, PATH).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("template", ["a{}1", "{}", "!{}é"])
def test_every_code_point(library, template):
    """Splitting, composing and lower case follow the library's Unicode tables, whatever Python's are."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(template.format(c) for c in points[i : i + 256]) for i in range(0, len(points), 256)]
    encoder = Encoder(Vocabulary(vocabulary_source(PATH)))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t.encode() for t in texts], pa.binary())], names=["id", "data"])
    got = []
    for part, _, _ in slices(batch):
        ids, bounds = encoder.encode(part)
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert [i for i, (x, y) in enumerate(zip(got, want, strict=True)) if x != y] == []


def test_encode_and_decode(spark, library):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    tokens = bpe.encode(docs, PATH)
    back = {r["id"]: r["text"] for r in bpe.decode(tokens, PATH).collect()}
    assert back == {i: library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, t in enumerate(TEXTS)}
    assert bpe.encode(docs.limit(0), PATH).count() == 0
    nulls = spark.createDataFrame([(1, None)], "id long, ids binary")
    assert [tuple(r) for r in bpe.decode(nulls, PATH).collect()] == [(1, "")]


@settings(max_examples=150, deadline=None)
@given(word=st.text(alphabet="abcdexyz!'éñ", min_size=1, max_size=90))
def test_short_and_long_words_merge_alike(vocabulary, library, word):
    """Rank arrays (short words), whole passes (long ones) and the library agree."""
    data = word.encode()
    parts = vocabulary.inner[np.frombuffer(data, np.uint8)].copy()
    parts[-1] = vocabulary.final[data[-1]]
    rows, size = vocabulary.merge_rows(np.stack([parts, parts]))
    assert rows[0, : size[0]].tolist() == rows[1, : size[1]].tolist() == vocabulary.merge_long(parts).tolist()
    if word.isalpha():
        assert rows[0, : size[0]].tolist() == library.encode(word, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(ids=st.lists(st.integers(0, 60_000), max_size=40))
def test_decoding_any_ids(vocabulary, library, ids):
    got = vocabulary.decode(np.array(ids, np.uint32), np.array([0, len(ids)]))[0].decode()
    assert got == library.decode(ids, skip_special_tokens=False)


EOD = 49407


def plain_counts(tokens: list[int]) -> list[int]:
    out, n = [], 0
    for t in tokens:
        if t == EOD:
            out.append(n)
            n = 0
        else:
            n += 1
    return out + ([n] if tokens and tokens[-1] != EOD else [])


@pytest.mark.parametrize("block_tokens", [1, 3, 7, 1000])
def test_counts_across_block_borders(spark, tmp_path, block_tokens):
    rng = random.Random(block_tokens)
    files = {"a": [EOD] * 3, "b": [1, 2, 3], "c": [], "d": [7] * 30 + [EOD]}
    files |= {f"r{i}": [rng.choice([EOD, 1, 2, 3, 4]) for _ in range(rng.randrange(60))] for i in range(8)}
    files |= {"_under": [1, EOD, 2], ".dot": [EOD, 5], "below/deep": [3, 3, EOD]}
    (tmp_path / "below").mkdir()
    for name, tokens in files.items():
        (tmp_path / name).write_bytes(np.array(tokens, "<u2").tobytes())
    (tmp_path / "odd").write_bytes(b"\x07\x00\x01")  # a token and half of one
    files["odd"] = [7]
    blocks = token_files.file_blocks(spark, str(tmp_path), block_tokens=block_tokens)
    got: dict[str, dict[int, int]] = {name: {} for name in files}
    for r in token_files.token_counts(blocks, EOD).collect():
        got[r["file"]][r["doc_no"]] = r["n_tokens"]
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: plain_counts(v) for k, v in files.items()}


def test_counts_of_documents(spark):
    texts = TEXTS + ["word " * n for n in (1, 50, 3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["id"]: r["n_tokens"] for r in token_files.document_token_counts(docs, PATH, EOD, block_tokens=16, file_tokens=64).collect()}
    want = {r["id"]: r["n_tokens"] for r in bpe.encode(docs.withColumn("text", F.regexp_replace("text", r"<\|", "< |")), PATH).collect()}
    assert got.keys() == want.keys() and {i: n for i, n in got.items() if i != 3} == {i: n for i, n in want.items() if i != 3}
    assert token_files.document_token_counts(docs.limit(0), PATH, EOD).count() == 0


def test_long_files_are_read_in_ranges(spark, tmp_path):
    """A file beyond the size of a Spark value, mostly a hole of zeros, is counted by many tasks."""
    with open(tmp_path / "long.bin", "wb") as file:
        file.write(np.array([5, EOD, 6], "<u2").tobytes())
        file.seek(3 << 30)
        file.write(np.array([EOD, 9], "<u2").tobytes())
    blocks = token_files.file_blocks(spark, str(tmp_path), block_tokens=1 << 24)
    got = sorted((r["doc_no"], r["n_tokens"]) for r in token_files.token_counts(blocks, EOD).collect())
    assert got == [(0, 1), (1, (3 << 29) - 2), (2, 1)]
