"""Labelled rows for training, and follow-the-regularised-leader updates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linetally.llm.batches import bound_batches, quoted


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of an id's text, modulo ``parts``; null for a null id."""
    return (F.crc32(id_col.cast("string").cast("binary")) % parts).cast("int")


#: Bytes of text that a model is fitted on, at most, and of one of its texts.
TRAINING_BYTES = 64 << 20
TRAINING_TEXT_BYTES = 1 << 20


def labelled_texts(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    parts: int,
    held_out: int,
    most: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_bytes: int = TRAINING_BYTES,
    most_text_bytes: int = TRAINING_TEXT_BYTES,
) -> DataFrame:
    """``(id, data, y)`` of a bounded sample of labelled rows outside the held-out part.

    Ids are taken by their hash, so the same ones on every run: at most ``most`` of them, and of
    these, in the same order, as many as have ``most_bytes`` of text together. Ids whose texts are
    longer than ``most_text_bytes`` (all rows of the id together) teach nothing. Only ids and labels
    (16 bytes each, ``most`` of them) are broadcast. Ids with several labels have the
    smallest; null labels count as none.
    """
    hashed = [F.xxhash64("id"), F.col("id")]
    chosen = (
        labels.select(quoted(id_col).cast("long").alias("id"), quoted(label).cast("int").alias("y"))
        .where(F.col("y").isNotNull() & (fold(F.col("id"), parts) != held_out))
        .groupBy("id")
        .agg(F.min("y").alias("y"))
        .orderBy(*hashed)
        .limit(most)
    )
    texts = bound_batches(docs).select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").cast("binary").alias("data"))
    # The length is taken of the string itself: no text is copied for it.
    size = F.coalesce(F.octet_length(quoted(text_col).cast("string")), F.lit(0)).cast("long")
    sizes = docs.select(quoted(id_col).cast("long").alias("id"), size.alias("size")).join(F.broadcast(chosen), "id")
    sizes = sizes.groupBy("id", "y").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).where((F.col("size") <= most_text_bytes) & (F.col("rows") <= most_text_bytes))
    # At most ``most`` ids, so this window is bounded; a row counts a byte, as empty texts may be many.
    running = sizes.withColumn("running", F.sum(F.col("size") + F.col("rows")).over(Window.orderBy(*hashed)))
    return texts.join(F.broadcast(running.where(F.col("running") <= most_bytes).select("id", "y")), "id")


class Ftrl:
    """Per-coordinate follow-the-regularised-leader (proximal) with sparse weights."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.z = np.zeros(size)
        self.n = np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        step = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / step)

    def update(self, at: np.ndarray, w: np.ndarray, g: np.ndarray) -> None:
        """One step for distinct coordinates ``at`` with weights ``w`` and gradients ``g``."""
        n = self.n[at]
        grown = n + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[at] = grown


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))
