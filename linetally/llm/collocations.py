"""Phrase collocation mining by best-first branch and bound.

A phrase of 2 to 4 words that occurs ``a`` times scores ``floor(2000000 a / (l + r))`` at each cut
into a first part (``l`` times) and a rest (``r`` times); the lowest cut counts. Whatever a prefix
grows into occurs at most as often as the prefix, and its first word is a first part, so
``2000000 a / (l + a)`` of the prefix bounds every score below it. Prefixes grow in the order
of these bounds: a round expands all of a language down to one bound, phrases that reach it are
then all known with exact counts, and if 2000 of them survive, ties included, the language is
settled. Otherwise the next round goes further down, at last to 0.

Growing by a word is one scan of the texts: tasks count only windows whose prefix is to be
expanded, or whose rest is a phrase that a longer one may displace. A window's words are
64-bit hashes; the texts of words are carried by the table of frequent words. What a scan is to
count is a table of marks, sized by its keys; above ``MOST_MARKS`` keys there is none, and
the scan counts all windows of its length, with the same result.

Rows: null texts are empty, a null language is ``und``; empty texts and tables give nothing. Repeated
rows and ids count as often as they are there. Ids are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linetally.llm.batches import LOWER, Texts, bound_batches, mixed, quoted, signed, slices, table, tidy, word_hashes, words
from linetally.llm.store import written_and_released as written
from linetally.operators.rows import first_rows

LEAST = 30
LONGEST = 4
FIRST = 2000
NO_LANGUAGE = "und"
#: A candidate falls if a longer one has 4/5 of its count.
_SHARE = (4, 5)
_UNIT = 2_000_000
#: How many pairs' scores, as a multiple of the phrases wanted, the first rounds go down to; the last goes to 0.
ROUNDS = (3, 30)
#: Keys that a table of marks may have; it has four to eight bytes for each.
MOST_MARKS = 1 << 21
FREQUENT, EXPAND, CANDIDATE = 1, 2, 4

_SPACES = b" \t"
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_IS_BREAK = np.zeros(256, dtype=bool)
_IS_BREAK[list(_BREAKS)] = True
_IN_WORD = ~_IS_BREAK
_IN_WORD[list(_SPACES)] = False
_LONG_WORD = 64
_STEP = 0xC2B2AE3D27D4EB4F


def gram_keys(lang: np.ndarray, columns: Sequence[np.ndarray]) -> np.ndarray:
    """A 64-bit value of a language and some words."""
    out = lang.copy()
    for w in columns:
        out *= np.uint64(_STEP)
        out += w
    return mixed(out)


def lang_hash(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


class Marks(NamedTuple):
    """Flags of word sequences of one length, in a table of slots. Sequences may share a slot,
    so a mark may be there by chance, but none is missing."""

    slots: Broadcast

    def flags(self, lang: np.ndarray, columns: Sequence[np.ndarray]) -> np.ndarray:
        own = self.slots.value
        return own[gram_keys(lang, columns) & np.uint64(len(own) - 1)]


def marks(keys: DataFrame, length: int, count: int, most: int = MOST_MARKS) -> Marks | None:
    """Marks of ``keys(lang, w1, ..., flags)``, of which there are ``count``; None above ``most``."""
    if count > most:
        return None
    size = 1 << max(6, (4 * count).bit_length())
    names = [f"w{i + 1}" for i in range(length)]

    def run(batches):
        for batch in batches:
            lang = np.array([lang_hash(x) for x in batch.column(0).to_pylist()], dtype=np.uint64)
            at = gram_keys(lang, [batch.column(i + 1).to_numpy().view(np.uint64) for i in range(length)]) & np.uint64(size - 1)
            yield table([pa.array(signed(at)), batch.column(length + 1)], ["slot", "flags"])

    found = keys.select("lang", *names, F.col("flags").cast("int")).mapInArrow(run, "slot long, flags int")
    found = found.groupBy("slot").agg(F.bit_or("flags").alias("flags")).toArrow()
    slots = np.zeros(size, dtype=np.uint8)
    slots[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return Marks(keys.sparkSession.sparkContext.broadcast(slots))


#: Alternatives of which one must hold, each a list of conditions ``(marks, first word, words, flag)``.
Rules = Sequence[Sequence[tuple[Marks | None, int, int, int]]]


class Pieces(NamedTuple):
    """Words of a slice, in order: bytes, hashes, and a number that differs between pieces."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    value: np.ndarray
    piece: np.ndarray
    row: np.ndarray


def pieces(texts: Texts) -> Pieces:
    buf = LOWER[texts.buf]
    found = words(buf, texts.offsets, _IN_WORD)
    value = word_hashes(buf, found)
    for i in np.flatnonzero(found.end - found.start > _LONG_WORD).tolist():
        value[i] = xxhash.xxh3_64_intdigest(buf[found.start[i] : found.end[i]].tobytes())
    row = found.rows()
    piece = np.cumsum(_IS_BREAK[buf])[found.start] + row * (len(buf) + 1) if len(buf) else np.empty(0, np.int64)
    return Pieces(buf, found.start, found.end, value, piece, row)


def _source(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    lang = F.coalesce(quoted(lang_col).cast("string"), F.lit(NO_LANGUAGE))
    return bound_batches(docs).select(lang.alias("lang"), quoted(text_col).cast("string").cast("binary").alias("data")).where("data IS NOT NULL")


def _languages(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """``(number of each row's language, languages, a hash of each)``."""
    coded = batch.column(0).dictionary_encode()
    names = coded.dictionary
    return coded.indices.to_numpy(zero_copy_only=False), names, np.array([lang_hash(x) for x in names.to_pylist()], dtype=np.uint64)


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> DataFrame:
    """``lang, w, word, n``: words found at least ``least`` times; a null word has the total of its language."""

    def run(batches):
        for batch in batches:
            code, names, hashes = _languages(batch)
            for texts, a, b in slices(batch):
                p = pieces(texts)
                lang = code[a:b][p.row]
                _, at, n = np.unique(gram_keys(hashes[lang], [p.value]), return_index=True, return_counts=True)
                data = p.buf.tobytes()
                own = [data[x:y] for x, y in zip(p.start[at].tolist(), p.end[at].tolist(), strict=True)]
                total = np.bincount(lang, minlength=len(names))
                here = np.flatnonzero(total)
                yield table(
                    [
                        names.take(pa.array(np.concatenate([lang[at], here]))),
                        np.concatenate([signed(p.value[at]), np.zeros(len(here), np.int64)]),
                        pa.array([*own, *[None] * len(here)], pa.binary()),
                        np.concatenate([n, total[here]]),
                    ],
                    ["lang", "w", "word", "n"],
                )

    found = _source(docs, text_col, lang_col).mapInArrow(tidy(run), "lang string, w long, word binary, n long")
    counted = found.groupBy("lang", "w", "word").agg(F.sum("n").alias("n"))
    return counted.where((F.col("n") >= least) | F.col("word").isNull())


def gram_counts(docs: DataFrame, length: int, rules: Rules, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> DataFrame:
    """``lang, w1, ..., a``: sequences of ``length`` words that a rule admits, found at least ``least`` times.

    All occurrences of a sequence are admitted or none, so counts are exact. Tasks combine
    equal sequences of a batch, and Spark those of a task, before the shuffle.
    """
    names = [f"w{i + 1}" for i in range(length)]

    def run(batches):
        for batch in batches:
            code, langs, hashes = _languages(batch)
            found: list[tuple] = []
            for texts, a, b in slices(batch):
                p = pieces(texts)
                n = max(0, len(p.value) - length + 1)
                at = np.flatnonzero(p.piece[:n] == p.piece[length - 1 :][:n])
                lang = code[a:b][p.row[at]]
                columns = [p.value[at + i] for i in range(length)]
                admitted = np.zeros(len(at), dtype=bool)
                for conditions in rules:
                    holds = np.ones(len(at), dtype=bool)
                    for own, first, size, flag in conditions:
                        if own is not None:
                            holds &= own.flags(hashes[lang], columns[first : first + size]) & flag != 0
                    admitted |= holds
                found.append((lang[admitted], *[c[admitted] for c in columns]))
            if found:
                lang, *columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                _, at, n = np.unique(gram_keys(hashes[lang], columns), return_index=True, return_counts=True)
                yield table([langs.take(pa.array(lang[at])), *[signed(c[at]) for c in columns], n], ["lang", *names, "a"])

    schema = "lang string, " + "".join(f"{n} long, " for n in names) + "a long"
    found = _source(docs, text_col, lang_col).mapInArrow(tidy(run), schema)
    return found.groupBy("lang", *names).agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def scored(a: str, left: str, right: str) -> Column:
    """``floor(2000000 a / (left + right))``, exact beyond 64 bits."""
    return F.expr(f"({_UNIT} * cast({a} AS decimal(20, 0))) div (cast({left} AS decimal(20, 0)) + cast({right} AS decimal(20, 0)))")


def _lowest(cuts: Sequence[tuple[str, str]]) -> Column:
    """The cut of the lowest score; of equal ones the first."""
    rows = [F.struct(scored("a", x, y).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for k, (x, y) in enumerate(cuts, 1)]
    return F.array_min(F.array(*rows))


def _counts_of(grams: DataFrame, names: Sequence[str], count: str) -> DataFrame:
    """The counts of ``grams``, named for a join: words as ``names``, the count as ``count``."""
    own = [c for c in grams.columns if c.startswith("w") and c != "word"]
    return grams.select("lang", *[F.col(c).alias(n) for c, n in zip(own, names, strict=True)], F.col("n" if "n" in grams.columns else "a").alias(count))


def _surviving(candidates: DataFrame, longer: DataFrame, length: int) -> DataFrame:
    """Candidates that no longer sequence, one word more on either side, displaces.

    A sequence two words longer that displaced one would hold one a word longer that does.
    """
    names = [f"w{i + 1}" for i in range(length)]
    sides = [_counts_of(longer.select("lang", *[f"w{i + 1 + shift}" for i in range(length)], "a"), names, "longer") for shift in (0, 1)]
    most = sides[0].unionByName(sides[1]).groupBy("lang", *names).agg(F.max("longer").alias("longer"))
    share, of = _SHARE
    kept = candidates.join(most, ["lang", *names], "left").where(F.col("longer").isNull() | (of * F.col("longer") < share * F.col("a")))
    return kept.drop("longer")


def _limits(pairs: DataFrame, wanted: int | None) -> DataFrame:
    """``lang, t``: for each language the score of its pair number ``wanted``; 0 with fewer pairs."""
    # At most 1,000,001 scores a language, so this window is bounded whatever the number of pairs.
    by_score = pairs.groupBy("lang", "score").agg(F.count("*").alias("n"))
    reached = by_score.selectExpr("lang", "score", "sum(n) OVER (PARTITION BY lang ORDER BY score DESC) AS place")
    t = F.lit(0).cast("long") if wanted is None else F.coalesce(F.max(F.when(F.col("place") >= wanted, F.col("score"))), F.lit(0))
    return reached.groupBy("lang").agg(t.alias("t"))


class _Miner:
    def __init__(self, docs: DataFrame, text_col: str, lang_col: str, least: int, first: int, most_marks: int):
        self.docs, self.columns, self.least, self.first, self.most_marks = docs, {"text_col": text_col, "lang_col": lang_col}, least, first, most_marks
        counted = written(word_counts(docs, least=least, **self.columns), "phrases-words")
        self.totals = counted.where("word IS NULL").select("lang", F.col("n").alias("total"))
        self.words = counted.where(f"word IS NOT NULL AND n >= {least}")
        self.single = self.words.select("lang", F.col("w").alias("w1"), "n")
        frequent = self.marked(self.single.select("lang", "w1", F.lit(FREQUENT).alias("flags")), 1)
        found = self.count(2, [[(frequent, 0, 1, FREQUENT), (frequent, 1, 1, FREQUENT)]])
        both = found.join(self.of_word("w1", "c1"), ["lang", "w1"]).join(self.of_word("w2", "c2"), ["lang", "w2"])
        self.pairs = written(both.select("lang", "w1", "w2", "a", "c1", _lowest([("c1", "c2")]).alias("cut"), scored("a", "c1", "a").alias("bound")).selectExpr("*", "cut.score"), "phrases-pairs")

    def of_word(self, word: str, count: str) -> DataFrame:
        return _counts_of(self.single, [word], count)

    def of_pair(self, first: str, second: str, count: str) -> DataFrame:
        return _counts_of(self.pairs.select("lang", "w1", "w2", "a"), [first, second], count)

    def marked(self, keys: DataFrame, length: int) -> Marks | None:
        return marks(keys, length, keys.count(), self.most_marks)

    def count(self, length: int, rules: Rules) -> DataFrame:
        return written(gram_counts(self.docs, length, rules, least=self.least, **self.columns), f"phrases-{length}")

    def expand(self, limits: DataFrame) -> DataFrame:
        """Surviving phrases of the languages in ``limits(lang, t)`` that score at least ``t``:
        ``lang, w1, w2, w3, w4, a, l, r, score``, with null for words that are not there."""
        reach = F.when(F.col("bound") >= F.col("t"), EXPAND).otherwise(0).bitwiseOR(F.when(F.col("score") >= F.col("t"), CANDIDATE).otherwise(0))

        pairs = written(self.pairs.join(limits, "lang").withColumn("flags", reach.bitwiseOR(FREQUENT)), "phrases-frontier")
        of_two = self.marked(pairs.select("lang", "w1", "w2", "flags"), 2)
        found = self.count(3, [[(of_two, 0, 2, EXPAND), (of_two, 1, 2, FREQUENT)], [(of_two, 1, 2, CANDIDATE), (of_two, 0, 2, FREQUENT)]])
        parts = found.join(limits, "lang").join(self.of_word("w1", "c1"), ["lang", "w1"]).join(self.of_word("w3", "c3"), ["lang", "w3"])
        parts = parts.join(self.of_pair("w1", "w2", "c12"), ["lang", "w1", "w2"]).join(self.of_pair("w2", "w3", "c23"), ["lang", "w2", "w3"])
        cut = _lowest([("c1", "c23"), ("c12", "c3")])
        threes = parts.select("lang", "w1", "w2", "w3", "a", "t", "c1", cut.alias("cut"), scored("a", "c1", "a").alias("bound")).selectExpr("*", "cut.score")
        threes = written(threes.withColumn("flags", reach), "phrases-frontier")

        of_three = self.marked(threes.where("flags > 0").select("lang", "w1", "w2", "w3", "flags"), 3)
        fours = self.count(4, [[(of_three, 0, 3, EXPAND), (of_two, 2, 2, FREQUENT)], [(of_three, 1, 3, CANDIDATE), (of_two, 0, 2, FREQUENT)]])
        heads = threes.where(F.col("flags").bitwiseAND(EXPAND) != 0).select("lang", "w1", "w2", "w3", "t", "c1", F.col("a").alias("c123"))
        parts = fours.join(heads, ["lang", "w1", "w2", "w3"]).join(self.of_word("w4", "c4"), ["lang", "w4"])
        parts = parts.join(self.of_pair("w1", "w2", "c12"), ["lang", "w1", "w2"]).join(self.of_pair("w3", "w4", "c34"), ["lang", "w3", "w4"])
        # The rest after the first word occurs at least as often as the whole.
        near = F.least(scored("a", "c1", "a"), scored("a", "c12", "c34"), scored("a", "c123", "c4")) >= F.col("t")
        parts = written(parts.where(near), "phrases-fours")
        rests = self._rests(parts, found)
        cut = _lowest([("c1", "c234"), ("c12", "c34"), ("c123", "c4")])
        whole = parts.join(rests, ["lang", "w2", "w3", "w4"]).withColumn("cut", cut).where(F.col("cut.score") >= F.col("t"))

        def shown(df: DataFrame, length: int) -> DataFrame:
            own = [F.col(f"w{i + 1}") if i < length else F.lit(None).cast("long").alias(f"w{i + 1}") for i in range(LONGEST)]
            return df.select("lang", *own, "a", "cut.l", "cut.r", "cut.score")

        def candidates(df: DataFrame) -> DataFrame:
            return df.where(F.col("flags").bitwiseAND(CANDIDATE) != 0)

        kept = shown(_surviving(candidates(pairs), found, 2), 2)
        kept = kept.unionByName(shown(_surviving(candidates(threes), fours, 3), 3))
        return written(kept.unionByName(shown(whole, 4)), "phrases-surviving")

    def _rests(self, fours: DataFrame, threes: DataFrame) -> DataFrame:
        """``lang, w2, w3, w4, c234``: how often the last three words of each of ``fours`` occur."""
        key = ["lang", "w2", "w3", "w4"]
        known = _counts_of(threes, key[1:], "c234")
        missing = fours.select(*key).distinct().join(known, key, "left_anti")
        wanted = written(missing.select("lang", *[F.col(f"w{i + 2}").alias(f"w{i + 1}") for i in range(3)], F.lit(FREQUENT).alias("flags")), "phrases-rests")
        count = wanted.count()
        if count == 0:
            return known
        own = self.count(3, [[(marks(wanted, 3, count, self.most_marks), 0, 3, FREQUENT)]])
        return known.unionByName(_counts_of(own.join(wanted.drop("flags"), ["lang", "w1", "w2", "w3"], "left_semi"), key[1:], "c234"))

    def settle(self) -> DataFrame:
        """Surviving phrases of every language, at least its first ones, ties included."""
        settled, left = [], None
        for wanted in (*ROUNDS, None):
            pairs = self.pairs if left is None else self.pairs.join(left, "lang", "left_semi")
            limits = written(_limits(pairs, None if wanted is None else wanted * self.first), "phrases-limits")
            kept = self.expand(limits)
            counts = limits.join(kept.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left").na.fill(0, ["kept"])
            done = written(counts.withColumn("done", (F.col("kept") >= self.first) | (F.col("t") == 0)), "phrases-settled")
            settled.append(kept.join(done.where("done").select("lang"), "lang", "left_semi"))
            left = done.where("NOT done").select("lang")
            if not left.take(1):
                break
        out = settled[0]
        for more in settled[1:]:
            out = out.unionByName(more)
        return out

    def texts(self, phrases: DataFrame) -> DataFrame:
        for i in range(LONGEST):
            word = self.words.select("lang", F.col("w").alias(f"w{i + 1}"), F.col("word").cast("string").alias(f"t{i + 1}"))
            phrases = phrases.join(word, ["lang", f"w{i + 1}"], "left")
        return phrases.withColumn("phrase", F.concat_ws(" ", *[f"t{i + 1}" for i in range(LONGEST)]))


def collocations(docs: DataFrame, first: int = FIRST, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", most_marks: int = MOST_MARKS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``first`` phrases of each language.

    Candidates have 2 to 4 words within a piece of text and occur ``least`` times or more; those
    that a longer candidate displaces (4/5 of the count) are left out. By score, count and phrase.
    """
    miner = _Miner(docs, text_col, lang_col, least, first, most_marks)
    found = miner.texts(miner.settle()).join(miner.totals, "lang")
    ranked = first_rows(found, ["lang"], [F.desc("score"), F.desc("a"), "phrase"], first, "rank", "phrase")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
