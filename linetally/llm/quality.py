"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL.

Features are words and pairs of words, and the same over word shapes (letters, capitals,
digits and marks in their order; a word that repeats the one before has a shape of its
own). A feature's value is its share of the text's n-grams of its kind, so a score is a
sparse dot product that needs one gather and one sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linetally.llm.batches import LOWER, NOT_SPACE, Texts, bound_batches, id_and_bytes, mixed, slices, table, tidy, word_hashes, words
from linetally.llm.training import Ftrl, fold, labelled_texts, sigmoid

BITS = 18
#: Labelled ids that a classifier is fitted on, at most.
TRAINING_ROWS = 4_000
EPOCHS = 3
_KINDS = 4
_SCALE = 8.0
_REPEATED = np.uint64(0x5851F42D4C957F2D)

#: Shape of a byte: small letters and all beyond ASCII, capitals, digits; marks are their own.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x61:0x7B] = _SHAPE[0x80:] = ord("a")
_SHAPE[0x41:0x5B] = ord("A")
_SHAPE[0x30:0x3A] = ord("0")


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """``(index, row)``: four features a word, and the row bounds in that list."""
    found = words(texts.buf, texts.offsets, NOT_SPACE)
    plain = word_hashes(LOWER[texts.buf], found)
    again = np.zeros(len(plain), dtype=bool)
    again[1:] = plain[1:] == plain[:-1]
    first = np.zeros(len(plain), dtype=bool)
    heads = found.first[:-1]
    first[heads[heads < len(plain)]] = True
    again &= ~first
    shape_buf = _SHAPE[texts.buf]
    keep = np.ones(len(shape_buf), dtype=bool)
    keep[1:] = shape_buf[1:] != shape_buf[:-1]
    keep[found.start] = True
    keep &= NOT_SPACE[texts.buf]
    kept = np.concatenate([[0], np.cumsum(keep)])
    shapes = word_hashes(shape_buf[keep], found._replace(start=kept[found.start], end=kept[found.end]))
    shapes[again] = _REPEATED
    columns = []
    for kind, h in enumerate((plain, shapes)):
        before = np.roll(h, 1)
        before[first] = np.uint64(kind + 1)
        columns += [mixed(h + np.uint64(2 * kind)), mixed(h * np.uint64(3) + mixed(before + np.uint64(2 * kind + 1)))]
    index = (np.stack(columns, axis=1) >> np.uint64(64 - BITS)).astype(np.int64) + (np.arange(_KINDS) << BITS)
    return index, found.first


def train(rows: list[tuple[int, np.ndarray, int]]) -> np.ndarray:
    """Weights (the last one is the intercept) from ``(id, features of a text, label)``."""
    model = Ftrl((_KINDS << BITS) + 1, alpha=0.8, beta=1.0, l1=0.02, l2=0.001)
    rows = sorted(rows, key=lambda r: (mixed(np.array([r[0]], dtype=np.int64).view(np.uint64))[0], r[0], r[2], len(r[1])))
    made = []
    for _, index, y in rows:
        at, count = np.unique(index, return_counts=True)
        made.append((np.append(at, _KINDS << BITS), np.append(count * (_SCALE / max(1, len(index))), 1.0), y))
    for _ in range(EPOCHS):
        for at, value, y in made:
            w = model.weights(at)
            model.update(at, w, (sigmoid(w @ value) - y) * value)
    return model.weights().astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 3, held_out: int = 1, most: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights learnt in one task from at most ``most`` labelled ids and ``TRAINING_BYTES`` of their
    texts (see ``labelled_texts``), so the task holds some hundred MB of features at most.

    Without any labelled row all weights are 0 and every score is 0.5.
    """

    def run(batches):
        rows = []
        for batch in batches:
            for texts, a, b in slices(batch):
                index, first = features(texts)
                for i, (x, y) in enumerate(zip(texts.ids.to_pylist(), batch.column(2).slice(a, b - a).to_pylist(), strict=True)):
                    rows.append((x, index[first[i] : first[i + 1]].ravel().astype(np.int32), y))
        yield table([pa.array([train(rows).tobytes()], pa.binary())], ["weights"])

    found = labelled_texts(docs, labels, label, parts, held_out, most, id_col, text_col).repartition(1).mapInArrow(tidy(run), "weights binary").collect()
    return np.frombuffer(found[0][0], np.float32) if found else np.zeros((_KINDS << BITS) + 1, np.float32)


def scores(texts: Texts, weights: np.ndarray) -> np.ndarray:
    index, first = features(texts)
    total = np.concatenate([[0.0], np.cumsum(weights[index].sum(axis=1, dtype=np.float64))])
    per_row = (total[first[1:]] - total[first[:-1]]) * _SCALE / np.maximum(1, _KINDS * np.diff(first))
    return sigmoid(per_row + float(weights[-1]))


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every row; null and empty texts have the score of the intercept."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            for texts, _, _ in slices(batch):
                yield table([texts.ids, scores(texts, shared.value)], ["id", "score"])

    return id_and_bytes(docs, id_col, text_col).mapInArrow(tidy(run), "id long, score double")


def keep_good(docs: DataFrame, weights: np.ndarray, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows whose text scores at least ``least``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            data = batch.column(at).cast(pa.binary())
            pair = pa.RecordBatch.from_arrays([data, data], names=["a", "b"])
            good = [scores(texts, shared.value) >= least for texts, _, _ in slices(pair)]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])
    return bound_batches(docs).toDF(*plain.names).mapInArrow(tidy(run), plain).toDF(*docs.columns)


def quality_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``(id, held_out, score, predicted)`` by a classifier fitted on the labels."""
    scored = score(docs, fit(docs, labels, **options))
    part = fold(F.col("id"), options.get("parts", 3)) == options.get("held_out", 1)
    return scored.select("id", F.coalesce(part, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
