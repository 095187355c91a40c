"""Texts in tasks: Arrow batches as byte buffers, words found and hashed with numpy.

Spark hands over batches of a few MB (``bound_batches``), and a batch is handled in slices
of at most ``SLICE_BYTES`` of text (or one row, if that alone is longer), so a task's
memory is bounded by the longest text, not by the number of rows.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 19
BATCH_BYTES = 4 << 20

SPACE_BYTES = b" \t\n\x0b\x0c\r"


def _mask(chosen) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chosen)] = True
    return table


#: Bytes of words as white space delimits them.
NOT_SPACE = ~_mask(SPACE_BYTES)
#: Bytes of words of ASCII letters, digits and everything beyond ASCII.
ALNUM = _mask([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: ASCII lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Bytes that begin a code point.
LEAD = ~_mask(range(0x80, 0xC0))


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def bound_batches(df: DataFrame) -> DataFrame:
    """Let the session make Arrow batches of at most ``BATCH_BYTES`` (or one row)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def tidy(run: Callable) -> Callable:
    """``run``, after which the worker gives its freed memory back, as it will serve other tasks."""

    def tidied(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)

    return tidied


def id_and_bytes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads; no other column, whatever its name, gets in the way."""
    bound_batches(df)
    return df.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").cast("binary").alias("data"))


class Texts(NamedTuple):
    """Some rows: ids as an Arrow array, all texts in one buffer, and where each begins."""

    ids: pa.Array
    buf: np.ndarray
    offsets: np.ndarray
    present: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def rows(self) -> Iterator[bytes]:
        data = self.buf.tobytes()
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            yield data[a:b]


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES, ids: int = 0, data: int = 1) -> Iterator[tuple[Texts, int, int]]:
    """``(texts, first row, end row)`` of slices of a batch; a null text is empty."""
    column = batch.column(data)
    if len(column) == 0:
        return
    present = ~np.asarray(column.is_null().to_numpy(zero_copy_only=False), dtype=bool)
    if not present.all():
        column = column.fill_null(b"")
    column = column.cast(pa.large_binary())
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(values, dtype=np.uint8) if values is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), len(column))
        at = offsets[first : end + 1]
        yield Texts(batch.column(ids).slice(first, end - first), whole[at[0] : at[-1]], at - at[0], present[first:end]), first, end
        first = end


def scan_texts(df: DataFrame, id_col: str, text_col: str, work: Callable, schema: str) -> DataFrame:
    """Run ``work(texts) -> list of arrays`` over all rows, in the order of ``schema``."""
    source = id_and_bytes(df, id_col, text_col)

    def run(batches):
        for batch in batches:
            for texts, _, _ in slices(batch):
                yield table(work(texts), names)

    names = [part.split()[0] for part in schema.split(",")]
    return source.mapInArrow(tidy(run), schema)


def table(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


class Words(NamedTuple):
    """Words of a slice: their bytes ``start:end``, and ``first[d]:first[d + 1]`` those of row d."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """Longest runs of word bytes; none reaches over the end of a row."""
    inside = is_word[buf]
    if len(inside) == 0:
        empty = np.empty(0, dtype=np.int64)
        return Words(empty, empty, np.zeros(len(offsets), dtype=np.int64))
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    cut = offsets[1:-1]
    before[cut[cut < len(buf)]] = False
    cut = cut[cut > 0]
    after[cut - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, offsets))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public-domain constants of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_STEP = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
#: A 64-bit value for every byte.
BYTE_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


_POWERS: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        n = max(n, SLICE_BYTES + 1)
        _POWERS["up"] = _powers(_BASE, n)
        _POWERS["down"] = _powers(pow(_BASE, -1, 1 << 64), n)
    return _POWERS["up"], _POWERS["down"]


class Spans:
    """64-bit hashes of any spans of a buffer: a polynomial in an odd base over random byte values.

    Equal spans have equal hashes in every task; other short ones differ up to chance (about
    2^-64 for a pair). Long regular spans may not: two strings of two letters in a Thue-Morse
    pattern of 1,024 bytes collide in any odd base, so hash words of more than some dozen bytes
    otherwise where that matters.
    """

    def __init__(self, buf: np.ndarray):
        up, self.down = _power_tables(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUE[buf] * up[: len(buf)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = (self.sums[end] - self.sums[start]) * self.down[start]
        return mixed(out + (end - start).astype(np.uint64) * np.uint64(_STEP))


def word_hashes(buf: np.ndarray, found: Words) -> np.ndarray:
    return Spans(buf).hashes(found.start, found.end)


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of ``hashes[i:i + k]`` for each i (rows are not respected: see ``window_starts``)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= np.uint64(_BASE)
        out += hashes[j : j + n]
    return mixed(out)


def window_counts(first: np.ndarray, k: int) -> np.ndarray:
    """How many windows of k words each row has."""
    return np.maximum(np.diff(first) - (k - 1), 0)


def window_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of k words within rows, and the bounds of each row in that list."""
    counts = window_counts(first, k)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    starts = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - first[:-1], counts)
    return starts, bounds


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values[first[d]:first[d + 1]]``; 0 for an empty row."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind in "uf" else np.int64), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
