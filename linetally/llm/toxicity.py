"""Toxicity by multiple-instance learning: labels are of documents, scores of sentences.

A sentence's probability is a logistic function of hashed words and word beginnings; a
document's is the noisy-or of its sentences, ``1 - prod(1 - p)``. Only that product meets the label in
training, and the same weights then tell which sentences offend.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linetally.llm.batches import ALNUM, LOWER, Spans, Texts, id_and_bytes, mixed, slices, table, tidy, words
from linetally.llm.training import Ftrl, fold, labelled_texts, sigmoid

BITS = 19
#: Labelled ids that a model is fitted on, at most.
TRAINING_ROWS = 8_000
EPOCHS = 3
#: Where a sentence begins before anything is learnt: most do not offend.
PRIOR = -7.0
_DOCS_A_STEP = 16
#: Beginnings of words, in bytes, that are features beside the whole word.
BEGINNINGS = (4, 5, 6)
_PER_WORD = 1 + len(BEGINNINGS)
#: Bytes that end a sentence.
_STOPS = np.zeros(256, dtype=bool)
_STOPS[list(b".!?\n")] = True


def sentences(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(features, first word of each sentence and the end, row of each sentence, its byte span)``.

    A sentence ends at ``.``, ``!``, ``?`` or a line end; ones without words are left out.
    Features are ``_PER_WORD`` indexes a word. A word that repeats the one before in its
    sentence is left out.
    """
    buf = LOWER[texts.buf]
    found = words(buf, texts.offsets, ALNUM)
    spans = Spans(buf)
    whole = spans.hashes(found.start, found.end)
    stops = np.concatenate([[0], np.cumsum(_STOPS[texts.buf])])
    row = found.rows()
    new = np.ones(len(whole), dtype=bool)
    new[1:] = (stops[found.start[1:]] != stops[found.start[:-1]]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    span = np.stack([found.start[first], found.end[np.append(first[1:], len(whole)) - 1]], axis=1) if len(first) else np.empty((0, 2), np.int64)
    kept = new.copy()
    kept[1:] |= whole[1:] != whole[:-1]
    bounds = np.concatenate([[0], np.cumsum(kept)])[np.append(first, len(whole))]
    start, end = found.start[kept], found.end[kept]
    columns = [whole[kept]] + [spans.hashes(start, np.minimum(end, start + k)) + np.uint64(k) for k in BEGINNINGS]
    index = (mixed(np.stack(columns, axis=1)) >> np.uint64(64 - BITS)).astype(np.int32)
    return index, bounds, row[first], span


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, x)


def train(rows: list[tuple[int, np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights (the last one is the intercept) from ``(id, features, sentence sizes in words, label)``."""
    model = Ftrl((1 << BITS) + 1, alpha=0.5, beta=1.0, l1=1.5, l2=0.01)
    bias = 1 << BITS
    rows = [r for r in rows if len(r[2])]
    rows.sort(key=lambda r: (mixed(np.array([r[0]], dtype=np.int64).view(np.uint64))[0], r[0], r[3], len(r[1])))
    offset = PRIOR
    for _ in range(EPOCHS):
        for i in range(0, len(rows), _DOCS_A_STEP):
            step = rows[i : i + _DOCS_A_STEP]
            index = np.concatenate([r[1].ravel() for r in step])
            size = _PER_WORD * np.concatenate([r[2] for r in step])
            per_row = np.array([len(r[2]) for r in step])
            y = np.array([r[3] for r in step])
            at, which = np.unique(index, return_inverse=True)
            w = model.weights(np.append(at, bias))
            start = np.cumsum(size) - size
            z = np.add.reduceat(w[which], start) + w[-1] + offset
            total = np.add.reduceat(_softplus(z), np.cumsum(per_row) - per_row)
            p = sigmoid(z)
            factor = np.where(y > 0, -np.exp(-total) / np.maximum(-np.expm1(-total), 1e-9), 1.0)
            pull = p * np.repeat(factor, per_row)
            g = np.bincount(which, weights=np.repeat(pull, size), minlength=len(at))
            model.update(np.append(at, bias), w, np.append(g, pull.sum() / _DOCS_A_STEP))
    out = model.weights()
    out[bias] += offset
    return out.astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 5, held_out: int = 0, most: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights learnt in one task from at most ``most`` labelled ids and ``TRAINING_BYTES`` of their
    texts (see ``labelled_texts``), so the task holds some hundred MB of features at most.

    Without any labelled row only the prior speaks.
    """

    def run(batches):
        rows = []
        for batch in batches:
            for texts, a, b in slices(batch):
                index, bounds, row, _ = sentences(texts)
                first = np.searchsorted(row, np.arange(len(texts) + 1))
                for i, (x, y) in enumerate(zip(texts.ids.to_pylist(), batch.column(2).slice(a, b - a).to_pylist(), strict=True)):
                    own = bounds[first[i] : first[i + 1] + 1]
                    rows.append((x, index[own[0] : own[-1]], np.diff(own), y))
        yield table([pa.array([train(rows).tobytes()], pa.binary())], ["weights"])

    found = labelled_texts(docs, labels, label, parts, held_out, most, id_col, text_col).repartition(1).mapInArrow(tidy(run), "weights binary").collect()
    if found:
        return np.frombuffer(found[0][0], np.float32)
    return np.append(np.zeros(1 << BITS, np.float32), np.float32(PRIOR))


def score(docs: DataFrame, weights: np.ndarray, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, offending)`` of every row: the noisy-or, and the sentences of at least ``least``.

    Null and empty texts, and texts without words, have no sentence and score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            for texts, _, _ in slices(batch):
                index, bounds, row, span = sentences(texts)
                total = np.concatenate([[0.0], np.cumsum(shared.value[index].sum(axis=1, dtype=np.float64))])
                z = total[bounds[1:]] - total[bounds[:-1]] + float(shared.value[-1])
                first = np.searchsorted(row, np.arange(len(texts) + 1))
                none = np.concatenate([[0.0], np.cumsum(_softplus(z))])
                p = -np.expm1(none[first[:-1]] - none[first[1:]])
                offending: list[list[str]] = [[] for _ in range(len(texts))]
                for i in np.flatnonzero(sigmoid(z) >= least).tolist():
                    offending[row[i]].append(texts.buf[span[i, 0] : span[i, 1]].tobytes().decode("utf-8", "replace"))
                yield table([texts.ids, np.clip(p, 0.0, 1.0), pa.array(offending, pa.list_(pa.string()))], ["id", "score", "offending"])

    return id_and_bytes(docs, id_col, text_col).mapInArrow(tidy(run), "id long, score double, offending array<string>")


def toxicity_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``(id, held_out, score, predicted, offending)`` by a model fitted on the labels."""
    scored = score(docs, fit(docs, labels, **options))
    part = fold(F.col("id"), options.get("parts", 5)) == options.get("held_out", 0)
    return scored.select("id", F.coalesce(part, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")
