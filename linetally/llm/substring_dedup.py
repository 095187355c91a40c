"""Substring dedup: Rabin-Karp hashes of every window of some words, counted in Spark.

A window's hash is the polynomial of its words' 61-bit values modulo 2^61 - 1, made for all
windows of a slice at once by doubling. A second polynomial, modulo 2^64, deals windows to
buckets, so that a bucket's number adds its own bits to the hash. Tasks combine the windows of
a batch first: of equal ones only that of the smallest id goes on to be numbered, and the
others are known to be repeats. Spark shuffles hashes by bucket in arrays, and numbers equal
ones by id; whatever has another before it is a repeat. The repeated hashes go back
to their documents, where runs of repeated windows become the largest intervals to remove.

Rows: a row without id is compared with no other row (only what repeats within it goes); rows
of one id are neither before nor after each other. Null and empty texts have no words, and
texts of fewer words than a window lose nothing. Ids are numbers (they are cast to long).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linetally.llm.batches import NOT_SPACE, SPACE_BYTES, Texts, Words, id_and_bytes, mixed, quoted, row_sums, signed, slices, table, tidy, window_starts, word_hashes, words
from linetally.llm.store import written_and_released

WINDOW = 20
#: Bytes of text whose windows one shuffle partition is meant to number, and the most partitions.
PARTITION_BYTES = 8 << 20
MOST_PARTITIONS = 1 << 16
#: Buckets for each partition, so that partitions come out alike.
_BUCKETS = 16
#: Words of more bytes are hashed by xxh3, as a polynomial modulo 2^64 is weak on long regular strings.
_LONG_WORD = 64

_PRIME = (1 << 61) - 1
# Bases of the two polynomials: any odd numbers of 61 and 64 bits.
_BASE = 0x1B873593CC9E2D51 % _PRIME
_BUCKET_BASE = 0x9FB21C651E98DF25
_LOW31, _LOW30, _P = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1), np.uint64(_PRIME)
_61, _31, _30 = np.uint64(61), np.uint64(31), np.uint64(30)


def _reduced(t: np.ndarray) -> np.ndarray:
    t = (t & _P) + (t >> _61)
    t[t >= _P] -= _P
    return t


def times(a: np.ndarray, b: int) -> np.ndarray:
    """``a * b`` modulo 2^61 - 1, not yet reduced (below 2^64 - 2^61); both below 2^61."""
    b1, b0 = np.uint64(b >> 31), np.uint64(b & (1 << 31) - 1)
    a1, a0 = a >> _31, a & _LOW31
    middle = a1 * b0
    middle += a0 * b1
    out = a1 * (b1 + b1)
    out += a0 * b0
    out += middle >> _30
    out += (middle & _LOW30) << _31
    return out


def rabin_karp(x: np.ndarray, k: int) -> np.ndarray:
    """``sum(x[i + j] * BASE^(k - 1 - j)) mod 2^61 - 1`` for every i, by doubling."""

    def joined(left: np.ndarray, right: np.ndarray, n: int, at: int) -> np.ndarray:
        m = min(len(left), len(right) - at)
        return _reduced(_reduced(times(left[:m], pow(_BASE, n, _PRIME))) + right[at : at + m])

    return _doubled(x, k, joined)


def bucket_hash(x: np.ndarray, k: int) -> np.ndarray:
    """The same sum in another base modulo 2^64, mixed."""

    def joined(left: np.ndarray, right: np.ndarray, n: int, at: int) -> np.ndarray:
        m = min(len(left), len(right) - at)
        return left[:m] * np.uint64(pow(_BUCKET_BASE, n, 1 << 64)) + right[at : at + m]

    return mixed(_doubled(x, k, joined))


def _doubled(x: np.ndarray, k: int, joined: Callable) -> np.ndarray:
    if len(x) < k:
        return np.empty(0, np.uint64)
    whole, size, tail, tail_size = x, 1, None, 0
    while True:
        if k & size:
            tail = whole if tail is None else joined(whole, tail, tail_size, size)
            tail_size += size
        if tail_size == k:
            return tail
        whole, size = joined(whole, whole, size, size), size * 2


def word_values(texts: Texts) -> tuple[Words, np.ndarray]:
    """Words between white space and a 64-bit value of each."""
    found = words(texts.buf, texts.offsets, NOT_SPACE)
    values = word_hashes(texts.buf, found)
    for i in np.flatnonzero(found.end - found.start > _LONG_WORD).tolist():
        values[i] = xxhash.xxh3_64_intdigest(texts.buf[found.start[i] : found.end[i]].tobytes())
    return found, values


def windows(texts: Texts, k: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """``(words, bounds of each row's windows, hashes, bucket hashes)`` of all windows of k words."""
    found, values = word_values(texts)
    starts, bounds = window_starts(found.first, k)
    if not len(starts):
        empty = np.empty(0, np.uint64)
        return found, bounds, empty, empty
    return found, bounds, rabin_karp(values % _P, k)[starts], bucket_hash(values, k)[starts]


def _first_of_equal(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Which elements, taken in ``order``, differ in a key from the one before."""
    first = np.ones(len(order), dtype=bool)
    first[1:] = False
    for key in keys:
        own = key[order]
        first[1:] |= own[1:] != own[:-1]
    return first


_MESSAGE = "bucket int, h array<long>, id array<long>"
_PIECE = 1 << 14


def _lists(bucket: np.ndarray, h: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """One row for each run of equal buckets, with the hashes and ids of the run."""
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, np.int64)
    ends = pa.array(np.append(cut, len(bucket)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(signed(x))) for x in (h, ids)]
    return table([pa.array(bucket[cut].astype(np.int32)), *lists], ["bucket", "h", "id"])


def combined(ids: np.ndarray, h: np.ndarray, spread: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Messages of a batch: for each bucket, hashes with the smallest id that holds them; and, in
    buckets below 0, hashes with the other ids of the batch that hold them."""
    bucket = (spread >> np.uint64(32)).astype(np.int64) % buckets
    order = np.lexsort((ids, h, bucket))
    own = _first_of_equal(order, bucket, h)
    other = order[_first_of_equal(order, bucket, h, ids) & ~own]
    own = order[own]
    own = own[np.lexsort((ids[own], bucket[own]))]
    yield _lists(bucket[own], h[own], ids[own])
    if len(other):
        other = other[np.argsort(ids[other], kind="stable")]
        # Known repeats are dealt out in pieces: they need no numbering, only a way to their documents.
        piece = -1 - (np.arange(len(other)) // _PIECE + int(bucket[other[0]])) % buckets
        yield _lists(piece, h[other], ids[other])


def _window_messages(docs: DataFrame, k: int, buckets: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            parts = []
            for texts, _, _ in slices(batch):
                known = ~np.asarray(texts.ids.is_null().to_numpy(zero_copy_only=False), dtype=bool)
                ids = texts.ids.fill_null(0).to_numpy(zero_copy_only=False)
                _, bounds, h, spread = windows(texts, k)
                count = np.diff(bounds)
                use = np.repeat(known, count)
                parts.append((np.repeat(ids, count)[use], h[use], spread[use]))
            if parts:
                columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                if len(columns[0]):
                    yield from combined(*columns, buckets)

    return id_and_bytes(docs, id_col, text_col).mapInArrow(tidy(run), _MESSAGE)


def partitions_for(docs: DataFrame, text_col: str = "text", partition_bytes: int = PARTITION_BYTES) -> int:
    """Shuffle partitions for the windows of these texts, by the bytes of the texts."""
    size = docs.agg(F.sum(F.octet_length(quoted(text_col).cast("string")))).first()[0] or 0
    return int(min(MOST_PARTITIONS, 1 + size // partition_bytes))


def repeats(docs: DataFrame, k: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """``(id, hashes)``: for each id, hashes of its windows that a smaller id holds too.

    Equal hashes of a bucket are numbered by id in one sort; ranks above 1 are repeats. A hash
    that a third of all documents hold comes once from every batch, not from every document.
    """
    n = partitions_for(docs, text_col, partition_bytes)
    dealt = _window_messages(docs, k, n * _BUCKETS, id_col, text_col).repartition(n, "bucket")
    each = dealt.select("bucket", "id", F.posexplode("h").alias("i", "h")).select("bucket", "h", F.get("id", F.col("i")).alias("id"))
    numbered = each.selectExpr("*", "rank() OVER (PARTITION BY bucket, h ORDER BY id) AS place")
    again = numbered.where((F.col("place") > 1) | (F.col("bucket") < 0))
    return again.groupBy("id").agg(F.collect_list("h").alias("hashes"))


def _with_repeats(docs: DataFrame, k: int, id_col: str, text_col: str, partition_bytes: int) -> DataFrame:
    """``(id, data, hashes)`` of every row; rows without id find nothing."""
    found = written_and_released(repeats(docs, k, id_col, text_col, partition_bytes), "window-repeats")
    rows = id_and_bytes(docs, id_col, text_col)
    # Rows without id are dealt out by their text, and meet no id as they have a key of their own kind.
    key: list[Column] = [F.coalesce("id", F.xxhash64("data")).alias("key"), F.col("id").isNull().alias("none")]
    left = rows.select(*key, "id", "data")
    right = found.select(F.col("id").alias("key"), F.lit(False).alias("none"), "hashes").hint("shuffle_hash")
    return left.join(right, ["key", "none"], "left").select("id", "data", "hashes")


def removed_words(texts: Texts, found: Words, bounds: np.ndarray, h: np.ndarray, repeated: pa.Array, k: int) -> np.ndarray:
    """A mark for each word that lies in a repeated window.

    ``repeated`` has a list of hashes (or null) for each row; a window that has an equal one
    before it in its own text is repeated as well.
    """
    rows = np.repeat(np.arange(len(texts)), np.diff(bounds))
    order = np.lexsort((h, rows))
    gone = np.zeros(len(h), dtype=bool)
    gone[order[~_first_of_equal(order, rows, h)]] = True
    lengths = repeated.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for row in np.flatnonzero(lengths).tolist():
        at = slice(bounds[row], bounds[row + 1])
        gone[at] |= np.isin(h[at], repeated[row].values.to_numpy(zero_copy_only=False).view(np.uint64))
    starts = window_starts(found.first, k)[0][gone]
    change = np.zeros(len(found.start) + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + k, -1)
    return np.cumsum(change[:-1]) > 0


def kept_texts(texts: Texts, found: Words, gone: np.ndarray) -> Iterator[bytes]:
    """The kept words of each row, joined by single spaces."""
    data = texts.buf.tobytes()
    for a, b, first, end in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist(), found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
        own = data[a:b].split()  # bytes split at the six characters of SPACE_BYTES
        mark = gone[first:end]
        yield b" ".join([w for w, g in zip(own, mark.tolist(), strict=True) if not g] if mark.any() else own)


assert sorted(SPACE_BYTES) == [c for c in range(256) if not bytes([c]).split()]


def _judged(docs: DataFrame, k: int, id_col: str, text_col: str, partition_bytes: int, columns: Callable, schema: str) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for texts, a, b in slices(batch):
                found, bounds, h, _ = windows(texts, k)
                gone = removed_words(texts, found, bounds, h, batch.column(2).slice(a, b - a), k)
                yield table([texts.ids, pa.array(np.diff(found.first)), pa.array(row_sums(gone.astype(np.int64), found.first)), *columns(texts, found, gone)], names)

    return _with_repeats(docs, k, id_col, text_col, partition_bytes).mapInArrow(tidy(run), schema)


def removal_intervals(docs: DataFrame, k: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """``(id, n_words, n_removed, starts, ends)`` of every row: the largest runs of words to remove,
    as word numbers from 0, each from ``starts[i]`` up to but without ``ends[i]``."""

    def columns(texts: Texts, found: Words, gone: np.ndarray) -> list:
        head, tail = gone.copy(), gone.copy()
        first = found.first[:-1][np.diff(found.first) > 0]
        head[1:] &= ~gone[:-1]
        head[first] = gone[first]
        tail[:-1] &= ~gone[1:]
        last = found.first[1:][np.diff(found.first) > 0] - 1
        tail[last] = gone[last]
        out = []
        for marks, add in ((head, 0), (tail, 1)):
            at = np.flatnonzero(marks)
            counts = np.concatenate([[0], np.cumsum(row_sums(marks.astype(np.int64), found.first))])
            base = np.repeat(found.first[:-1], np.diff(counts))
            out.append(pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), pa.array(at - base + add)))
        return out

    return _judged(docs, k, id_col, text_col, partition_bytes, columns, "id long, n_words long, n_removed long, starts array<long>, ends array<long>")


def kept_words(docs: DataFrame, k: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """``(id, n_words, n_removed, text)`` of every row: its kept words, joined by single spaces."""

    def columns(texts: Texts, found: Words, gone: np.ndarray) -> list:
        return [pa.array([t.decode() for t in kept_texts(texts, found, gone)], pa.string())]

    return _judged(docs, k, id_col, text_col, partition_bytes, columns, "id long, n_words long, n_removed long, text string")


def removal_digests(docs: DataFrame, k: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """``(id, n_words, n_removed, kept_sha256)`` of every row, the digest that of its kept words."""

    def columns(texts: Texts, found: Words, gone: np.ndarray) -> list:
        return [pa.array([hashlib.sha256(t).hexdigest() for t in kept_texts(texts, found, gone)], pa.string())]

    return _judged(docs, k, id_col, text_col, partition_bytes, columns, "id long, n_words long, n_removed long, kept_sha256 string")
