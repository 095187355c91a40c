"""Byte-pair encoding with contiguous rank arrays, and decoding.

A word's parts lie side by side in one row of an array, and so do the ranks of adjacent
pairs. The smallest rank is found by scanning the row, the boundary below it is deleted
by moving the rest up, and the ranks on both sides are looked up again. Words of one
length are worked on together, so every scan is one numpy call for many words.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers, pre_tokenizers

from linetally.llm.batches import NOT_SPACE, Texts, id_and_bytes, slices, table, tidy, word_hashes, words

#: Encoded stretches of text that a task remembers before it starts afresh.
REMEMBERED_STRETCHES = 250_000
#: Words of at most so many bytes are encoded together.
SHORT_WORD = 40
_NONE = np.int32(2**31 - 1)
_BLOCK = 1 << 12
#: Ids that are decoded together.
_DECODED = 1 << 20
_LIBRARY = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary's strings."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        letters.setdefault(b, chr(0x100 + len(letters) - len(plain)))
    return [letters[b] for b in range(256)]


@functools.cache
def members(kind: str) -> str:
    """The letters (L) or numbers (N) of the vocabulary's library, as a set for the ``regex`` package.

    ``unicodedata``, ``regex`` and the library each follow Unicode tables of their own age. They agree
    on what the oldest assigns; of all other code points the library is asked, on the driver.
    """
    unknown = "".join(c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if unicodedata.category(c) == "Cn")
    asked = pre_tokenizers.Split(Regex(rf"[^\p{{{kind}}}]+"), "removed").pre_tokenize_str(unknown)
    theirs = set("".join(piece for piece, _ in asked))
    ours = set(regex.findall(rf"\p{{{kind}}}", unknown))
    less, more = _ranges(ours - theirs), _ranges(theirs - ours)
    return rf"[\p{{{kind}}}" + (f"--[{less}]" if less else "") + "]" + more


def _ranges(chars: set[str]) -> str:
    points = np.array(sorted(map(ord, chars)), dtype=np.int64)
    first = np.flatnonzero(np.diff(points, prepend=-2) > 1)
    last = np.append(first[1:], len(points)) - 1
    return "".join(f"\\U{points[a]:08x}-\\U{points[b]:08x}" for a, b in zip(first, last, strict=True)) if len(points) else ""


class Source(NamedTuple):
    """A tokenizer file's text, and the sets of letters and numbers that its library knows."""

    text: str
    letters: str
    numbers: str


class Vocabulary:
    """What a tokenizer file (``tokenizer.json``, word-end BPE over bytes) says, as arrays."""

    def __init__(self, source: Source):
        spec = json.loads(source.text)
        model = spec["model"]
        end = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or model.get("unk_token") or model.get("continuing_subword_prefix") or spec.get("decoder"):
            raise ValueError("a BPE vocabulary over bytes, without unknown token and decoder, is needed")
        ids = model["vocab"]
        letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters], dtype=np.int32)
        self.final = np.array([ids[c + end] for c in letters], dtype=np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        key = np.array([ids[a] << 32 | ids[b] for a, b in pairs], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in pairs], dtype=np.int32)
        _, last = np.unique(key[::-1], return_index=True)  # a pair listed twice has its last rank
        kept = np.sort(len(key) - 1 - last)
        order = kept[np.argsort(key[kept], kind="stable")]
        self.key, self.rank, self.made = key[order], order.astype(np.int32), made
        latest = np.full(max(ids.values()) + 1, -1, dtype=np.int64)
        np.maximum.at(latest, made, np.arange(len(made)))
        #: Every merge comes after all those that make its parts, as training leaves them.
        self.in_order = bool((np.maximum(latest[key >> 32], latest[key & 0xFFFFFFFF]) < np.arange(len(key))).all())
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        names = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        tokens = [names[i].encode() + b" " if i in names else b"" for i in range(max(names) + 2)]
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pattern = "(?V1)" + split.replace(r"\s", r"\p{White_Space}").replace(r"\p{L}", source.letters).replace(r"\p{N}", source.numbers)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of adjacent parts; ``_NONE`` where they don't merge."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], _NONE)

    def merge_rows(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode words of one length, a row each: ``(parts, how many of a row count)``."""
        n, width = parts.shape
        out, size = parts.copy(), np.full(n, width)
        live = np.arange(n)
        ranks = self.ranks(parts[:, :-1], parts[:, 1:]) if width > 1 else np.empty((n, 0), np.int32)
        parts = parts.copy()
        while width > 1 and len(live):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(live)), at]
            done = best == _NONE
            if done.any():
                out[live[done], :width], size[live[done]] = parts[done], width
                keep = ~done
                live, parts, ranks, at, best = live[keep], parts[keep], ranks[keep], at[keep], best[keep]
                if not len(live):
                    return out, size
            row = np.arange(len(live))
            parts[row, at] = self.made[best]
            width -= 1
            column = np.arange(width)
            parts = np.where(column <= at[:, None], parts[:, :-1], parts[:, 1:])
            if width > 1:
                ranks = np.where(column[:-1] < at[:, None], ranks[:, :-1], ranks[:, 1:])
                left = at > 0
                ranks[row[left], at[left] - 1] = self.ranks(parts[row[left], at[left] - 1], parts[row[left], at[left]])
                right = at < width - 1
                ranks[row[right], at[right]] = self.ranks(parts[row[right], at[right]], parts[row[right], at[right] + 1])
        out[live, :width], size[live] = parts, width
        return out, size

    def merge_long(self, parts: np.ndarray) -> np.ndarray:
        """The same for one long word: equal ranks merge from the left, a whole pass at a time.

        One pass gives what one deletion after another gives where merges only use parts
        that earlier merges made: a new pair then never ranks before the one being merged.
        """
        while len(parts) > 1:
            ranks = self.ranks(parts[:-1], parts[1:])
            best = ranks.min()
            if best == _NONE:
                break
            at = np.flatnonzero(ranks == best)
            if not self.in_order:
                at = at[:1]
            elif len(at) > 1:  # of overlapping places (as in aaa) every second one counts, from the left
                new_run = np.concatenate([[True], np.diff(at) > 1])
                run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            parts = parts.copy()
            parts[at] = self.made[best]
            parts = np.delete(parts, at + 1)
        return parts

    def encode_words(self, distinct: list[str]) -> dict[str, bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers."""
        out: dict[str, bytes] = {}
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for word in distinct:
            data = word.encode("utf-8", "surrogatepass")
            if len(data) <= SHORT_WORD:
                by_length.setdefault(len(data), []).append((word, data))
            else:
                parts = self.inner[np.frombuffer(data, np.uint8)]
                parts[-1] = self.final[data[-1]]
                out[word] = self.merge_long(parts).astype("<u4").tobytes()
        for length, group in by_length.items():
            for i in range(0, len(group), _BLOCK):
                block = group[i : i + _BLOCK]
                raw = np.frombuffer(b"".join(d for _, d in block), np.uint8).reshape(len(block), length)
                parts = self.inner[raw]
                parts[:, -1] = self.final[raw[:, -1]]
                parts, size = self.merge_rows(parts)
                flat = parts[np.arange(length) < size[:, None]].astype("<u4").tobytes()
                end = (4 * np.cumsum(size)).tolist()
                at = 0
                for (word, _), e in zip(block, end, strict=True):
                    out[word] = flat[at:e]
                    at = e
        return out

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Texts of many id lists: token strings with a space between, as a tokenizer without decoder joins them.

        Ids that the vocabulary lacks are left out.
        """
        out: list[bytes] = []
        step = max(1, int(np.searchsorted(bounds, _DECODED, side="right")) - 1)
        for i in range(0, len(bounds) - 1, step):
            at = bounds[i : i + step + 1]
            part = np.minimum(ids[at[0] : at[-1]], len(self.token_size) - 1)
            data, ends = _gathered(self.token_bytes, self.token_start[part], self.token_size[part])
            data, ends = data.tobytes(), ends[at - at[0]].tolist()
            out += [data[a : max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return out


def _gathered(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``pool[start:start + size]`` of all entries, one after another, and where each begins."""
    bounds = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size, out=bounds[1:])
    return pool[np.repeat(start - bounds[:-1], size) + np.arange(bounds[-1])], bounds


class Encoder:
    """A vocabulary with the words, and the stretches between white space, that a task has met.

    White space ends every word, and neither composition nor lower case reach across it,
    so a stretch has the same ids wherever it stands. Stretches are known by 64-bit hash.
    """

    def __init__(self, vocabulary: Vocabulary, spelt_special: bool = True):
        """``spelt_special``: whether a special token that a text spells out is that token."""
        self.vocabulary = vocabulary
        self.find = regex.compile(vocabulary.pattern).findall
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names and spelt_special else None
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, bytes] = {}
        self.slot: dict[int, int] = {}
        self.pool = np.empty(0, dtype=np.uint32)
        self.start = np.empty(0, dtype=np.int64)
        self.size = np.empty(0, dtype=np.int64)

    @staticmethod
    def normal(text: str) -> str:
        """Canonical composition and lower case, letter by letter (a final sigma is no exception)."""
        if text.isascii():
            return text.lower()
        if "Cn" in map(unicodedata.category, text):  # the library's tables may be newer than Python's
            return _LIBRARY.normalize_str(text)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _pieces(self, stretch: str) -> list[str | int]:
        """Words of a stretch; ids of the special tokens that are spelt out in it."""
        if self.special is None or not self.special.search(stretch):
            return self.find(self.normal(stretch))
        parts = self.special.split(stretch)
        return [y for i, x in enumerate(parts) for y in ([self.vocabulary.special[x]] if i % 2 else self.find(self.normal(x)))]

    def _learn(self, hashes: list[int], stretches: list[str]) -> None:
        pieces = [self._pieces(x) for x in stretches]
        new = set().union(*pieces) - self.words.keys()
        self.words.update({x: x.to_bytes(4, "little") for x in new if isinstance(x, int)})
        self.words.update(self.vocabulary.encode_words([x for x in new if isinstance(x, str)]))
        get = self.words.__getitem__
        ids = [b"".join(map(get, p)) for p in pieces]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.slot.update(zip(hashes, range(len(self.slot), len(self.slot) + len(hashes)), strict=True))
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), "<u4")])

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, one after another, and the bounds of each text's."""
        if len(self.slot) > REMEMBERED_STRETCHES:
            self._forget()
        found = words(texts.buf, texts.offsets, NOT_SPACE)
        distinct, where, which = np.unique(word_hashes(texts.buf, found), return_index=True, return_inverse=True)
        known = self.slot.get
        slots = np.fromiter((known(x, -1) for x in distinct.tolist()), np.int64, len(distinct))
        new = np.flatnonzero(slots < 0)
        if len(new):
            data, at = texts.buf.tobytes(), where[new]
            self._learn(distinct[new].tolist(), [data[a:b].decode("utf-8", "replace") for a, b in zip(found.start[at].tolist(), found.end[at].tolist(), strict=True)])
            slots[new] = np.arange(len(self.slot) - len(new), len(self.slot))
        slots = slots[which]
        ids, bounds = _gathered(self.pool, self.start[slots], self.size[slots])
        return ids, bounds[found.first]


def vocabulary_source(path: str) -> Source:
    """A tokenizer file, read where the job is started; tasks get it by broadcast (a few MB)."""
    with open(path, encoding="utf-8") as file:
        return Source(file.read(), members("L"), members("N"))


def _parts(values: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
    data, ends = memoryview(values.astype("<u4", copy=False)).cast("B"), (4 * bounds).tolist()
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids)`` of every row: ids as one binary of little-endian 32-bit integers.

    ``vocabulary`` is the path of a tokenizer file. A null or empty text, and one of white
    space only, has no ids. Rows with equal ids (or none) each give a row.
    """
    source = docs.sparkSession.sparkContext.broadcast(vocabulary_source(vocabulary))

    def run(batches):
        encoder = Encoder(Vocabulary(source.value))
        for batch in batches:
            for texts, _, _ in slices(batch):
                ids, bounds = encoder.encode(texts)
                yield table([texts.ids, np.diff(bounds), pa.array(_parts(ids, bounds), pa.binary())], ["id", "n_tokens", "ids"])

    return id_and_bytes(docs, id_col, text_col).mapInArrow(tidy(run), "id long, n_tokens long, ids binary")


def decode(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """``(id, text)`` from rows of ``encode``; null ids give an empty text."""
    source = tokens.sparkSession.sparkContext.broadcast(vocabulary_source(vocabulary))

    def run(batches):
        known = Vocabulary(source.value)
        for batch in batches:
            for texts, _, _ in slices(batch):
                out = known.decode(np.frombuffer(texts.buf.tobytes(), "<u4"), texts.offsets // 4)
                yield table([texts.ids, pa.array([x.decode() for x in out], pa.string())], ["id", "text"])

    return tokens.select("id", "ids").mapInArrow(tidy(run), "id long, text string")


def round_trip_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: both directions in one pass.

    Same rows as ``encode``; neither ids nor decoded texts leave the task.
    """
    source = docs.sparkSession.sparkContext.broadcast(vocabulary_source(vocabulary))

    def run(batches):
        known = Vocabulary(source.value)
        encoder = Encoder(known)
        for batch in batches:
            for texts, _, _ in slices(batch):
                ids, bounds = encoder.encode(texts)
                there = [hashlib.sha256(x).hexdigest() for x in _parts(ids, bounds)]
                back = [hashlib.sha256(x).hexdigest() for x in known.decode(ids, bounds)]
                yield table([texts.ids, np.diff(bounds), pa.array(there, pa.string()), pa.array(back, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_bytes(docs, id_col, text_col).mapInArrow(tidy(run), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
