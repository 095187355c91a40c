"""Benchmark decontamination: Wu-Manber search for word windows in whole texts.

The alphabet is words. All windows of one length m are searched together: a shift table
by blocks of two words says how far a place may move on when no window can end there; a
place of shift 0 looks up its last words in hash buckets, and the windows in the bucket
are compared with the text, byte by byte. Texts of a slice are cut into lanes that
advance side by side, overlapping by m - 1 words.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linetally.llm.batches import ALNUM, LOWER, Texts, bound_batches, mixed, quoted, slices, tidy, word_hashes, words

WINDOW = 10
#: Bytes of item text whose tables a task holds at once; more items are searched in turn.
BLOCK_BYTES = 8 << 20
_BLOCK = 2
_LANE = 512


class Patterns(NamedTuple):
    """Distinct windows of m words, sorted by the hash of their words."""

    m: int
    key: np.ndarray  # hash of all words, of which the bucket is the sorted run
    text: list[bytes]  # words joined by spaces
    items: list[list[int]]  # item numbers that have the window
    block: np.ndarray  # sorted hashes of blocks
    shift: np.ndarray  # how far a place may move whose last words are that block
    most: int  # and how far if no window has it


def _sequence_hash(hashes: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that end at each place."""
    out = np.zeros(len(ends), dtype=np.uint64)
    for j in range(k - 1, -1, -1):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[ends - j]
    return mixed(out)


def item_words(text: bytes) -> tuple[list[bytes], np.ndarray]:
    buf = LOWER[np.frombuffer(text, np.uint8)]
    found = words(buf, np.array([0, len(buf)]), ALNUM)
    data = buf.tobytes()
    return [data[a:b] for a, b in zip(found.start.tolist(), found.end.tolist(), strict=True)], word_hashes(buf, found)


def compile_items(texts: list[bytes], window: int = WINDOW) -> list[Patterns]:
    """Tables for the windows of all items; an item of fewer words is one window."""
    by_length: dict[int, dict[bytes, tuple[np.ndarray, list[int]]]] = {}
    for number, text in enumerate(texts):
        own, hashes = item_words(text)
        m = min(window, len(own))
        if not m:
            continue
        group = by_length.setdefault(m, {})
        for i in range(len(own) - m + 1):
            entry = group.setdefault(b" ".join(own[i : i + m]), (hashes[i : i + m], []))
            if not entry[1] or entry[1][-1] != number:
                entry[1].append(number)
    out = []
    for m, group in by_length.items():
        hashes = np.stack([h for h, _ in group.values()])
        last = np.full(len(hashes), m - 1)
        size = min(_BLOCK, m)
        key = _sequence_hash(hashes.ravel(), last + np.arange(len(hashes)) * m, m)
        block, shift = [], []
        for end in range(size - 1, m):
            block.append(_sequence_hash(hashes.ravel(), end + np.arange(len(hashes)) * m, size))
            shift.append(np.full(len(hashes), m - 1 - end))
        block, shift = np.concatenate(block), np.concatenate(shift)
        order = np.lexsort((shift, block))
        block, shift = block[order], shift[order]
        head = np.ones(len(block), dtype=bool)
        head[1:] = block[1:] != block[:-1]
        order = np.argsort(key, kind="stable")
        texts_of, items_of = list(group), [v[1] for v in group.values()]
        out.append(Patterns(m, key[order], [texts_of[i] for i in order], [items_of[i] for i in order], block[head], shift[head], m - size + 1))
    return out


def _found_at(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Index of each key in a sorted table, or -1."""
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return np.where(table[at] == key, at, -1)


def candidate_ends(hashes: np.ndarray, p: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window's hash ends, and the first entry of its bucket."""
    n = len(hashes)
    if n < p.m:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    size = min(_BLOCK, p.m)
    at = np.arange(p.m - 1, n, _LANE)
    stop = np.minimum(at + _LANE, n)
    ends, buckets = [], []
    while len(at):
        known = _found_at(p.block, _sequence_hash(hashes, at, size))
        step = np.where(known < 0, p.most, p.shift[known])
        full = np.flatnonzero(step == 0)
        if len(full):
            place = at[full]
            bucket = _found_at(p.key, _sequence_hash(hashes, place, p.m))
            ends.append(place[bucket >= 0])
            buckets.append(bucket[bucket >= 0])
        at = at + np.maximum(step, 1)
        live = at < stop
        if not live.all():
            at, stop = at[live], stop[live]
    if not ends:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(ends), np.concatenate(buckets)


def search(texts: Texts, tables: list[Patterns]) -> tuple[np.ndarray, np.ndarray, list[set[int]]]:
    """``(first word of each row and the end, which words are hit, item numbers of each row)``."""
    buf = LOWER[texts.buf]
    found = words(buf, texts.offsets, ALNUM)
    hashes = word_hashes(buf, found)
    hit = np.zeros(len(hashes) + 1, dtype=np.int32)
    items: list[set[int]] = [set() for _ in range(len(texts))]
    for p in tables:
        ends, buckets = candidate_ends(hashes, p)
        row = np.searchsorted(found.first, ends, side="right") - 1
        inside = ends - p.m + 1 >= found.first[row]
        for end, bucket, r in zip(ends[inside].tolist(), buckets[inside].tolist(), row[inside].tolist(), strict=True):
            first = end - p.m + 1
            text = b" ".join([buf[a:b].tobytes() for a, b in zip(found.start[first : end + 1].tolist(), found.end[first : end + 1].tolist(), strict=True)])
            key = p.key[bucket]
            while bucket < len(p.key) and p.key[bucket] == key:
                if p.text[bucket] == text:
                    hit[first] += 1
                    hit[end + 1] -= 1
                    items[r].update(p.items[bucket])
                bucket += 1
    return found.first, np.cumsum(hit[:-1]) > 0, items


def _blocks(items: DataFrame, id_col: str, text_col: str, limit: int):
    """Items in lists of at most ``limit`` bytes of text (or one item), in the order they come."""
    own, size = [], 0
    rows = items.select(quoted(id_col).cast("string").alias("item"), quoted(text_col).cast("string").cast("binary").alias("data"))
    for row in rows.where(F.col("data").isNotNull()).toLocalIterator():
        if own and size + len(row.data) > limit:
            yield own
            own, size = [], 0
        own.append((row.item, bytes(row.data)))
        size += len(row.data)
    yield own


_FOUND = T.StructType().add("n_words", "long").add("n_hit", "long").add("hit", "binary").add("items", T.ArrayType(T.StringType()))
_FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("hit", pa.binary()), ("items", pa.list_(pa.string()))])


def _searched(docs: DataFrame, at: int, items: list[tuple[str | None, bytes]], window: int, found: bool) -> DataFrame:
    """``docs`` with a last column of what the items hit; ``found``: it has one from items before."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(items)
    schema = docs.schema if found else T.StructType([*docs.schema.fields, T.StructField("found", _FOUND)])

    def run(batches):
        names = [x[0] for x in shared.value]
        tables = compile_items([x[1] for x in shared.value], window)
        for batch in batches:
            data = batch.column(at).cast(pa.binary())
            for texts, a, b in slices(pa.RecordBatch.from_arrays([data, data], names=["a", "b"])):
                first, hit, own = search(texts, tables)
                own = [{names[i] or "" for i in x} for x in own]
                hits = [hit[i:j] for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                part = batch.slice(a, b - a)
                columns = part.columns
                if found:
                    for i, old in enumerate(columns.pop().to_pylist()):
                        hits[i] = hits[i] | np.unpackbits(np.frombuffer(old["hit"], np.uint8), count=len(hits[i])).astype(bool)
                        own[i].update(old["items"])
                made = [{"n_words": len(h), "n_hit": int(h.sum()), "hit": np.packbits(h).tobytes(), "items": sorted(x)} for h, x in zip(hits, own, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(made, _FOUND_ARROW)], names=[*part.schema.names[: len(columns)], "found"])

    return bound_batches(docs).mapInArrow(tidy(run), schema)


def search_items(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with a last column ``found``: ``n_words``, a bit for each word that is hit, and item ids.

    Items go to the tasks by broadcast in blocks of at most ``block_bytes`` of text; each
    block is one more narrow step over the documents, so any number of items is searched
    with bounded memory and without a shuffle. Null texts have no words; items without
    words or with a null text hit nothing; items with equal ids count as one.
    """
    found = False
    at = docs.columns.index(text_col)
    out = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    for items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        out, found = _searched(out, at, items, window, found), True
    return out.toDF(*docs.columns, "found")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(id, n_words, n_hit, n_items, items_sha256, contaminated)`` of every row."""
    pair = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("data"))
    found = search_items(pair, benchmark, text_col="data", **options).select("id", "found.*")
    return found.select(
        "id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Rows in which no window of an item occurs, with all their columns."""
    found = search_items(docs, benchmark, text_col=text_col, **options)
    names = [f"c{i}" for i in range(len(docs.columns))]
    return found.toDF(*names, "found").where("found.n_hit = 0").drop("found").toDF(*docs.columns)
