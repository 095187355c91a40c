"""Quality rules by distribution: how far a text's histograms are from its language's.

A language's reference is made from all its documents: a histogram of character classes,
and one of its commonest words with one bin for all others. Labels with few words or documents
make no reference, as such a text would be measured by itself. A text is compared with the
reference of its own language by Jensen-Shannon distance (base 2, so 0 to 1), and only where
that language has none (or the text no language) with all of them, of which the nearest
counts. Texts too short for a stable histogram are not judged by it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linetally.llm.batches import ALNUM, LEAD, LOWER, NOT_SPACE, Texts, bound_batches, quoted, row_sums, slices, table, tidy, window_hashes, window_starts, word_hashes, words
from linetally.llm.store import written

#: Common words of a language.
COMMON_WORDS = 48
#: Languages whose common words are counted in a text at once; all languages have their turn.
LANGUAGES_AT_ONCE = 64
#: Fewer words than this, and the distances say nothing.
GUARD_WORDS = 40
#: What a language needs for a reference: so many words (letters and digits) and documents.
LEAST_REFERENCE_WORDS = 5_000
LEAST_REFERENCE_DOCS = 20
#: Distances from which a text is refused: so much, and more the shorter it is, as the
#: chance part of a distance shrinks with the square root of the length.
MOST_CLASS_DISTANCE = 0.16
MOST_WORD_DISTANCE = 0.33
SLACK = 1.0
REPEAT_WINDOW = 8
_FLUSH = 400_000

#: Classes of characters, by first byte: small, capital, digit, space, line end, the marks of
#: sentences, each of the symbols that scores count, other ASCII, controls; then by script.
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[0x00:0x20] = 0
_CLASS[0x21:0x7F] = 1
_CLASS[0x61:0x7B] = 2
_CLASS[0x41:0x5B] = 3
_CLASS[0x30:0x3A] = 4
_CLASS[[0x20, 0x09]] = 5
_CLASS[[0x0A, 0x0D]] = 6
_CLASS[list(b".,;:'\"-()")] = 7
_CLASS[list(b"!?")] = 8
_CLASS[list(b"#*$%&|<>")] = 9
_CLASS[0xC2:0xC4] = 10
_CLASS[0xC4:0xCE] = 11
_CLASS[0xCE:0xD0] = 12
_CLASS[0xD0:0xD4] = 13
_CLASS[0xD4:0xE0] = 14
_CLASS[0xE0:0xE3] = 15
_CLASS[0xE3:0xF0] = 16
_CLASS[0xF0:0x100] = 17
CLASSES = 18
_SUMS = CLASSES + 2
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def class_histograms(texts: Texts) -> np.ndarray:
    """Characters of each class in each row."""
    rows = len(texts)
    lead = LEAD[texts.buf]
    key = np.repeat(np.arange(rows) * CLASSES, np.diff(texts.offsets))[lead] + _CLASS[texts.buf[lead]]
    return np.bincount(key, minlength=rows * CLASSES).reshape(rows, CLASSES)


def _plain_words(texts: Texts):
    buf = LOWER[texts.buf]
    found = words(buf, texts.offsets, ALNUM)
    return buf, found, word_hashes(buf, found)


class Reference(NamedTuple):
    """A language: characters of each class, its common words with counts, all its words and documents."""

    lang: str
    classes: np.ndarray
    common: dict[bytes, int]
    words: int
    docs: int


def references(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", common: int = COMMON_WORDS, least_words: int = LEAST_REFERENCE_WORDS, least_docs: int = LEAST_REFERENCE_DOCS
) -> list[Reference]:
    """The references of all languages with at least ``least_words`` words and ``least_docs`` documents.

    Counted over all documents: tasks hand on sums, and of words only the commonest of each
    language reach the driver. Rows without a language, or without a text, count for none.
    """
    source = bound_batches(docs).select(quoted(lang_col).cast("string").alias("lang"), quoted(text_col).cast("string").cast("binary").alias("data")).where("lang is not null and data is not null")

    def run(batches):
        counts: dict[tuple[str, int], list] = {}
        classes: dict[str, np.ndarray] = {}

        def flush():
            keys = list(counts)
            yield table([pa.array([k[0] for k in keys], pa.string()), pa.array([counts[k][0] for k in keys], pa.binary()), pa.array([counts[k][1] for k in keys], pa.int64())], ["lang", "word", "n"])
            counts.clear()

        for batch in batches:
            for texts, _, _ in slices(batch):
                langs = texts.ids.to_pylist()
                chars = class_histograms(texts)
                buf, found, hashes = _plain_words(texts)
                names, lang = np.unique(np.array(langs, dtype=object).astype(str), return_inverse=True)
                of_word = np.repeat(lang, np.diff(found.first))
                for i, name in enumerate(names.tolist()):
                    own = np.flatnonzero(of_word == i)
                    classes[name] = classes.get(name, 0) + np.append(chars[lang == i].sum(axis=0), [len(own), (lang == i).sum()])
                    distinct, at, n = np.unique(hashes[own], return_index=True, return_counts=True)
                    at = own[at]
                    for h, a, b, k in zip(distinct.tolist(), found.start[at].tolist(), found.end[at].tolist(), n.tolist(), strict=True):
                        entry = counts.get((name, h))
                        if entry is None:
                            counts[name, h] = [buf[a:b].tobytes(), k]
                        else:
                            entry[1] += k
                if len(counts) > _FLUSH:
                    yield from flush()
        yield from flush()
        # sums of classes and of words travel as one-byte "words" that no text has: bytes 80 to BF alone
        keys = [(name, c) for name in classes for c in range(_SUMS)]
        yield table([pa.array([k[0] for k in keys], pa.string()), pa.array([bytes([0x80 + k[1]]) for k in keys], pa.binary()), pa.array([int(classes[k[0]][k[1]]) for k in keys], pa.int64())], ["lang", "word", "n"])

    counted = source.mapInArrow(tidy(run), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    is_sum = (F.length("word") == 1) & (F.hex("word") >= "80") & (F.hex("word") < "C0")
    order = W.partitionBy("lang", "is_sum").orderBy(F.desc("n"), "word")
    ranked = written(counted.withColumn("is_sum", is_sum).withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= max(common, _SUMS)) & (F.col("is_sum") | (F.col("rank") <= common))).drop("rank"), "references")
    enough = ranked.where("is_sum").groupBy("lang").agg(*[F.max(F.when(F.hex("word") == f"{0x80 + k:X}", F.col("n"))).alias(c) for c, k in (("words", CLASSES), ("docs", CLASSES + 1))])
    enough = enough.where((F.col("words") >= least_words) & (F.col("docs") >= least_docs)).select("lang")
    out: dict[str, tuple[np.ndarray, dict[bytes, int]]] = {}
    for row in ranked.join(enough, "lang", "left_semi").toLocalIterator():
        sums, own = out.setdefault(row.lang, (np.zeros(_SUMS, np.int64), {}))
        if row.is_sum:
            sums[row.word[0] - 0x80] = row.n
        else:
            own[bytes(row.word)] = row.n
    return [Reference(lang, sums[:CLASSES], own, int(sums[CLASSES]), int(sums[CLASSES + 1])) for lang, (sums, own) in sorted(out.items())]


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of ``p`` to the histogram ``q``; 1 for an empty row."""
    total = p.sum(axis=1, keepdims=True)
    p = p / np.maximum(total, 1)
    q = q / max(q.sum(), 1)
    m = (p + q) / 2

    def to_middle(x):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0.0).sum(axis=-1)

    out = np.sqrt(np.clip((to_middle(p) + to_middle(np.broadcast_to(q, p.shape))) / 2, 0.0, 1.0))
    return np.where(total[:, 0] > 0, out, 1.0)


class Judge:
    """References as sorted tables, to measure many texts at once."""

    def __init__(self, found: list[Reference]):
        self.number = {r.lang: i for i, r in enumerate(found)}
        self.classes = [r.classes for r in found]
        self.blocks = [self._block(found[i : i + LANGUAGES_AT_ONCE]) for i in range(0, len(found), LANGUAGES_AT_ONCE)]

    @staticmethod
    def _block(found: list[Reference]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        names = sorted({w for r in found for w in r.common})
        buf = np.frombuffer(b" ".join(names), np.uint8)
        at = words(buf, np.array([0, len(buf)]), NOT_SPACE)
        hashes = word_hashes(buf, at)
        order = np.argsort(hashes)
        keys, number = hashes[order], {names[i]: k for k, i in enumerate(order.tolist())}
        bins = []
        for r in found:
            at = np.array([number[w] for w in r.common], dtype=np.int64)
            n = np.array(list(r.common.values()), dtype=np.int64)
            bins.append((at, np.append(n, r.words - n.sum())))
        return keys, bins

    def measure(self, texts: Texts, langs: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Distance of each row by classes and by words: to its language's reference, or the nearest of all."""
        rows = len(texts)
        if not self.classes:
            return np.zeros(rows), np.zeros(rows)
        own = np.array([self.number.get(x, -1) for x in langs], dtype=np.int64)
        by_class, by_word = np.full(rows, 1.0), np.full(rows, 1.0)
        chars = class_histograms(texts)
        _, found, hashes = _plain_words(texts)
        of_row, total = found.rows(), np.diff(found.first)
        for b, (keys, bins) in enumerate(self.blocks):
            here = np.flatnonzero((own < 0) | (own // LANGUAGES_AT_ONCE == b))
            if not len(here):
                continue
            place = np.full(rows, -1, dtype=np.int64)
            place[here] = np.arange(len(here))
            counts = np.zeros((len(here), len(keys)), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                known = (keys[at] == hashes) & (place[of_row] >= 0)
                counts = np.bincount(place[of_row[known]] * len(keys) + at[known], minlength=counts.size).reshape(counts.shape)
            for i, (bins_of, q) in enumerate(bins, b * LANGUAGES_AT_ONCE):
                mine = here[(own[here] == i) | (own[here] < 0)]
                if not len(mine):
                    continue
                p = counts[place[mine]][:, bins_of]
                p = np.column_stack([p, total[mine] - p.sum(axis=1)])
                by_word[mine] = np.minimum(by_word[mine], distance(p, q))
                by_class[mine] = np.minimum(by_class[mine], distance(chars[mine], self.classes[i]))
        return by_class, by_word


def base_counts(texts: Texts) -> tuple[np.ndarray, ...]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of each row."""
    found = words(texts.buf, texts.offsets, NOT_SPACE)
    chars = row_sums((LEAD & NOT_SPACE)[texts.buf].astype(np.int64), texts.offsets)
    symbols = row_sums(_SYMBOL[texts.buf].astype(np.int64), texts.offsets)
    dup = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts.rows()):
        if b"\n" in text:
            lines = [x for x in text.split(b"\n") if x.strip()]
            dup[i] = len(lines) - len(set(lines))
    return np.diff(found.first), chars, symbols, dup, repeated_words(texts, found)


def repeated_words(texts: Texts, found, k: int = REPEAT_WINDOW) -> np.ndarray:
    """Words of each row that stand in a window of k words that occurs twice or more in it."""
    hashes = word_hashes(texts.buf, found)
    starts, bounds = window_starts(found.first, k)
    out = np.zeros(len(texts), dtype=np.int64)
    if not len(starts):
        return out
    windows = window_hashes(hashes, k)[starts]
    cover = np.zeros(len(hashes) + 1, dtype=np.int32)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a < 2:
            continue
        own = windows[a:b]
        order = np.argsort(own, kind="stable")
        same = own[order[1:]] == own[order[:-1]]
        if same.any():
            again = np.zeros(b - a, dtype=bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            at = starts[a:b][again]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + k, -1)
    return row_sums((np.cumsum(cover[:-1]) > 0).astype(np.int64), found.first)


def judge(
    docs: DataFrame,
    found: list[Reference],
    guard_words: int = GUARD_WORDS,
    most_class_distance: float = MOST_CLASS_DISTANCE,
    most_word_distance: float = MOST_WORD_DISTANCE,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Counts, distances and verdicts of every row, against references from ``references``.

    ``base_failed``: under 20 words, or over 30 % of them repeated in windows of 8.
    ``kept``: not so, and either too short for the guard or near enough by both distances.
    A null text has no words; without any reference every distance is 0. Rows need no language
    column: without one they are measured by the nearest reference.
    """
    shared = docs.sparkSession.sparkContext.broadcast(found)
    lang = quoted(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    source = bound_batches(docs).select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").cast("binary").alias("data"), lang.alias("lang"))
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]

    def run(batches):
        of = Judge(shared.value)
        for batch in batches:
            for texts, a, b in slices(batch):
                n, chars, symbols, dup, repeat = base_counts(texts)
                failed = (n < 20) | (100 * repeat > 30 * n)
                by_class, by_word = of.measure(texts, batch.column(2).slice(a, b - a).to_pylist())
                slack = SLACK / np.sqrt(np.maximum(n, 1))
                kept = ~failed & ((n < guard_words) | (by_class <= most_class_distance + slack) & (by_word <= most_word_distance + slack))
                yield table([texts.ids, n, chars, symbols, dup, repeat, failed, kept, by_class, by_word], names)

    return source.mapInArrow(tidy(run), "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double")
