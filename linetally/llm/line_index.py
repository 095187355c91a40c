"""Line dedup by a sharded minimal perfect hash.

Keys of repeated lines are hashed to 128 bits and dealt to shards by their first bits.
Each shard is built in a task of its own: levels of bit arrays, in which a key keeps the
first level where it meets no other, and the number of set bits before it is its slot.
The slots index two arrays: a fingerprint of the key, and the document that keeps it.
Documents probe these arrays; their lines are not joined with anything.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linetally.llm.batches import LEAD, bound_batches, mixed, quoted, slices, table, tidy
from linetally.llm.store import written

LEAST_CHARS = 20
LEAST_DOCS = 3
#: Keys a shard is meant to hold.
SHARD_KEYS = 1 << 16
#: Bytes of arrays that a task holds at once; more shards are probed in turn.
BUNDLE_BYTES = 32 << 20
_SPREAD = 2.0
_SEED = 0x9E3779B97F4A7C15


def line_key(line: bytes, least: int = LEAST_CHARS) -> bytes | None:
    """The line without white space at its ends, A-Z lower-cased; None if it has too few code points."""
    key = line.strip().lower()
    if len(key) < least:
        return None
    if not key.isascii() and int(LEAD[np.frombuffer(key, np.uint8)].sum()) < least:
        return None
    return key


def _hashed(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), dtype="<u8").reshape(-1, 2)
    return digests[:, 0].copy(), digests[:, 1].copy()


def _level(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(a ^ mixed(b + np.uint64((level + 1) * _SEED & (1 << 64) - 1))) % np.uint64(size)).astype(np.int64)


class Shard:
    """A minimal perfect hash of distinct 128-bit keys with two arrays in its slots.

    The second half of a key is its fingerprint: another key passes for it with chance 2^-64.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray, fingerprint: np.ndarray, keeper: np.ndarray):
        self.sizes, self.bits, self.fingerprint, self.keeper = sizes, bits, fingerprint, keeper
        self.starts = np.cumsum([0, *sizes[:-1]]) if sizes else np.zeros(0, np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.unpackbits(bits).reshape(-1, 64).sum(axis=1))]) if len(bits) else np.zeros(1, np.int64)

    @staticmethod
    def build(a: np.ndarray, b: np.ndarray, keeper: np.ndarray) -> Shard:
        sizes, parts, left, level = [], [], np.arange(len(a)), 0
        while len(left):
            size = -(-int(_SPREAD * len(left) + 1) // 64) * 64
            at = _level(a[left], b[left], level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(alone)
            left = left[~alone[at]]
            level += 1
        out = Shard(sizes, np.packbits(np.concatenate(parts)) if parts else np.empty(0, np.uint8), np.empty(0, np.uint64), np.empty(0, np.int64))
        slot = out.slots(a, b)
        out.fingerprint, out.keeper = np.empty_like(b), np.empty_like(keeper)
        out.fingerprint[slot], out.keeper[slot] = b, keeper
        return out

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key; any slot, or -1, for a key that the shard does not hold."""
        out = np.full(len(a), -1, dtype=np.int64)
        left = np.arange(len(a))
        for level, (start, size) in enumerate(zip(self.starts, self.sizes, strict=True)):
            at = _level(a[left], b[left], level, size) + start
            there = (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 != 0
            at = at[there]
            word, inside = at >> 6, at & 63
            octets = self.bits[(word[:, None] << 3) + np.arange(8)]
            rank = np.where(np.arange(64) < inside[:, None], np.unpackbits(octets, axis=1), 0).sum(axis=1)
            out[left[there]] = self.before[word] + rank
            left = left[~there]
            if not len(left):
                break
        return out

    def keepers(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(is the key held, the document that keeps it)``."""
        slot = self.slots(a, b)
        held = slot >= 0
        held[held] = self.fingerprint[slot[held]] == b[held]
        keeper = np.zeros(len(a), dtype=np.int64)
        keeper[held] = self.keeper[slot[held]]
        return held, keeper


class Index:
    """Some of the shards, by number."""

    def __init__(self, shards: dict[int, Shard], bits: int):
        self.shards, self.bits = shards, bits

    def keepers(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held, keeper = np.zeros(len(a), dtype=bool), np.zeros(len(a), dtype=np.int64)
        number = (a >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(a), np.int64)
        for n in np.unique(number).tolist():
            if n in self.shards:
                at = np.flatnonzero(number == n)
                held[at], keeper[at] = self.shards[n].keepers(a[at], b[at])
        return held, keeper


def repeated_keys(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(a, b, keeper)``: hashes of keys that at least ``least_docs`` documents hold, and the largest of them.

    A key counts once for an id; rows without an id count for none.
    """
    source = bound_batches(docs).select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").cast("binary").alias("data")).where("id is not null and data is not null")

    def run(batches):
        for batch in batches:
            for texts, _, _ in slices(batch):
                keys, ids = [], []
                for x, text in zip(texts.ids.to_pylist(), texts.rows(), strict=True):
                    own = {line_key(line, least_chars) for line in text.split(b"\n")} - {None}
                    keys += own
                    ids += [x] * len(own)
                a, b = _hashed(keys)
                yield table([a.view(np.int64), b.view(np.int64), pa.array(ids, pa.int64())], ["a", "b", "id"])

    pairs = source.mapInArrow(tidy(run), "a long, b long, id long").groupBy("a", "b", "id").agg(F.lit(1).alias("one"))
    return pairs.groupBy("a", "b").agg(F.sum("one").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= least_docs).select("a", "b", "keeper")


_SHARD = "shard int, sizes array<long>, bits binary, fingerprint binary, keeper binary"


def build_shards(keys: DataFrame, bits: int) -> DataFrame:
    """A row for each shard, built from its own keys only."""

    def build(pdf):
        import pandas as pd

        s = Shard.build(pdf["a"].to_numpy().view(np.uint64), pdf["b"].to_numpy().view(np.uint64), pdf["keeper"].to_numpy())
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "sizes": [s.sizes], "bits": [s.bits.tobytes()], "fingerprint": [s.fingerprint.tobytes()], "keeper": [s.keeper.tobytes()]})

    number = F.shiftrightunsigned("a", 64 - bits) if bits else F.lit(0)
    return keys.withColumn("shard", number.cast("int")).groupBy("shard").applyInPandas(build, _SHARD)


def _bundles(shards: DataFrame, limit: int):
    """Shards in lists of at most ``limit`` bytes (or one shard), fetched one after another."""
    own, size = [], 0
    for row in shards.toLocalIterator():
        here = sum(len(row[c]) for c in ("bits", "fingerprint", "keeper"))
        if own and size + here > limit:
            yield own
            own, size = [], 0
        own.append((row.shard, list(row.sizes), bytes(row.bits), bytes(row.fingerprint), bytes(row.keeper)))
        size += here
    yield own


def _probed(docs: DataFrame, at_id: int, at_text: int, bundle: list, bits: int, least_chars: int, marked: bool) -> DataFrame:
    """``docs`` with a last column: a bit for every line that goes. ``marked``: it has one already."""
    shared = docs.sparkSession.sparkContext.broadcast(bundle)
    schema = docs.schema if marked else T.StructType([*docs.schema.fields, T.StructField("drop", T.BinaryType())])

    def run(batches):
        index = Index({n: Shard(sizes, np.frombuffer(x, np.uint8), np.frombuffer(f, np.uint64), np.frombuffer(k, np.int64)) for n, sizes, x, f, k in shared.value}, bits)
        for batch in batches:
            ids, data = batch.column(at_id).cast(pa.int64()), batch.column(at_text).cast(pa.binary())
            for texts, a, b in slices(pa.RecordBatch.from_arrays([ids, data], names=["a", "b"])):
                keys, place, owner, counts = [], [], [], []
                n = 0
                for x, text in zip(texts.ids.to_pylist(), texts.rows(), strict=True):
                    lines = text.split(b"\n")
                    for i, line in enumerate(lines):
                        key = line_key(line, least_chars)
                        if key is not None:
                            keys.append(key)
                            place.append(n + i)
                            owner.append(-(1 << 63) if x is None else x)
                    counts.append(len(lines))
                    n += len(lines)
                held, keeper = index.keepers(*_hashed(keys))
                gone = np.zeros(n, dtype=bool)
                gone[np.array(place, np.int64)[held & (keeper != np.array(owner, np.int64))]] = True
                ends = np.cumsum(counts).tolist()
                parts = [gone[e - c : e] for e, c in zip(ends, counts, strict=True)]
                part = batch.slice(a, b - a)
                columns = part.columns
                if marked:
                    parts = [p | np.unpackbits(np.frombuffer(old, np.uint8), count=len(p)).astype(bool) for p, old in zip(parts, columns.pop().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())], names=[*part.schema.names[: len(columns)], "drop"])

    return docs.mapInArrow(tidy(run), schema)


def mark_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text", shard_keys: int = SHARD_KEYS, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """``docs`` with a last column ``drop``: a bit for every line of the text, set if it goes.

    A line goes if its key is held by at least ``least_docs`` documents and this is not the
    largest of their ids (a row without id is never it). The arrays of all shards are broadcast in bundles of at most ``bundle_bytes``; each bundle is one more
    narrow step over the documents. Null and empty texts are one empty line.
    """
    keys = written(repeated_keys(docs, least_chars, least_docs, id_col, text_col), "line-keys")
    bits = max(0, (max(1, keys.count()) // shard_keys).bit_length())
    shards = written(build_shards(keys, bits), "line-shards")
    marked = False
    at_id, at_text = docs.columns.index(id_col), docs.columns.index(text_col)
    out = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    for bundle in _bundles(shards, bundle_bytes):
        out, marked = _probed(out, at_id, at_text, bundle, bits, least_chars, marked), True
    return out.toDF(*docs.columns, "drop")


def _kept(text: bytes, drop: bytes) -> tuple[bytes, int, int]:
    lines = text.split(b"\n")
    if not any(drop):
        return text, len(lines), 0
    bits = np.unpackbits(np.frombuffer(drop, np.uint8), count=len(lines)).tolist()
    kept = [line for line, gone in zip(lines, bits, strict=True) if not gone]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def dedup_lines(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with repeated lines taken out of the text; all other columns as they are.

    A null text stays null; a text that loses all its lines is empty.
    """
    marked = mark_lines(docs, text_col=text_col, **options)
    marked = marked.toDF(*[f"c{i}" for i in range(len(marked.columns))])
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts, drops = batch.column(at), batch.column(batch.num_columns - 1)
            out = [t if t is None else _kept(t.encode(), d)[0].decode() for t, d in zip(texts.to_pylist(), drops.to_pylist(), strict=True)]
            columns = batch.columns[:-1]
            columns[at] = pa.array(out, texts.type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])
    return marked.mapInArrow(tidy(run), plain).toDF(*docs.columns)


def line_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(id, n_lines, n_dropped, kept_sha256)`` of every row."""
    pair = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("data"))
    marked = mark_lines(pair, id_col="id", text_col="data", **options)

    def run(batches):
        for batch in batches:
            rows = [_kept((t or "").encode(), d) for t, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield table([batch.column(0), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string())], ["id", "n_lines", "n_dropped", "kept_sha256"])

    return marked.mapInArrow(tidy(run), "id long, n_lines long, n_dropped long, kept_sha256 string")
