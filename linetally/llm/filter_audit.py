"""Filter interaction audit: what each filter of a chain removes, in every order of the chain.

Five failure conditions of a text: A fewer than 200 words, B fewer than half of the words
distinct, C more than 3 % capitals, D one of ``#$%&*|``, E the same text as that of a smaller id.
E is an existential self-join: a left-semi join on the text's hash, its exact text and a
smaller id. Rows that it marks are united with the failures of the other filters, and the
combinations of failures are counted; 120 orders are then read off at most 32 counts a part.

Rows: null texts are empty texts (they fail A, and E beside a smaller id without text). A null
language is the part of the empty string. A row without id neither fails E nor makes another
fail it, and has no labels. Rows of one id are judged each on its own: none is the smaller one.
An id with several label rows counts as good, or toxic, if one of them says so; ids are numbers.
An empty table has no parts, so no rows.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linetally.llm.batches import quoted
from linetally.llm.store import written_and_released as written

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 3
_SPACES = r"[\x20\x09-\x0D]+"
_MARKS = "[#$%&*|]"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_E = 1 << FILTERS.index("E")
#: A text whose copies are more than a 4096th of all rows is dealt out; there are fewer than 4096 such texts.
HOT_PARTS = 4096
LEAST_HOT = 1000
SALTS = 64


def _failures(text: Column) -> Column:
    """The bits of A to D. Each measure is one expression of built-in functions over the text."""
    words = F.array_remove(F.split(text, _SPACES), "")
    measured = F.struct(words.alias("words"), text.alias("text"))

    def bits(x: Column) -> Column:
        n = F.size(x["words"]).cast("long")
        letters = F.length(x["text"]).cast("long")
        capitals = letters - F.length(F.translate(x["text"], _CAPITALS, ""))
        failing = [
            n < LEAST_WORDS,
            100 * F.size(F.array_distinct(x["words"])) < LEAST_DISTINCT_PERCENT * n,
            100 * capitals > MOST_CAPITALS_PERCENT * letters,
            x["text"].rlike(_MARKS),
        ]
        out = F.lit(0)
        for i, fails in enumerate(failing):
            out = out.bitwiseOR(F.when(fails, 1 << i).otherwise(0))
        return out

    # One element, so that the words are cut once however often they are read.
    return F.transform(F.array(measured), bits)[0]


def _texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    rows = docs.select(quoted(id_col).cast("long").alias("id"), F.coalesce(quoted(lang_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    return rows.withColumn("h", F.xxhash64("text"))


def _salted(rows: DataFrame, hot: DataFrame, salt: Column) -> DataFrame:
    """``rows`` with a salt: 0, or ``salt`` where the hash is hot. ``hot`` has fewer than ``HOT_PARTS`` rows."""
    marked = rows.join(F.broadcast(hot), "h", "left")
    return marked.withColumn("salt", F.when(F.col("hot"), salt).otherwise(F.lit(0))).drop("hot")


def copies(texts: DataFrame, repeated: DataFrame, rows: int) -> DataFrame:
    """Rows of ``texts(id, part, text, h)`` whose exact text a smaller id has.

    ``repeated(h, n)`` lists the hashes that several ids share; other texts take no part. On
    the right, equal texts are one row with the smallest id, made before the shuffle. Copies
    of a frequent text are dealt out, and its right row is there once for each salt.
    """
    hot = repeated.where(F.col("n") > F.lit(max(LEAST_HOT, rows // HOT_PARTS))).select("h", F.lit(True).alias("hot"))
    near = texts.where("id IS NOT NULL").join(repeated.select("h"), "h", "left_semi")
    left = _salted(near, hot, F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).alias("l")
    firsts = near.groupBy("h", "text").agg(F.min("id").alias("first"))
    every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = firsts.join(F.broadcast(hot), "h", "left").select("h", "text", "first", F.explode(every).alias("salt")).alias("r")
    same = (F.col("l.h") == F.col("r.h")) & (F.col("l.salt") == F.col("r.salt")) & (F.col("l.text") == F.col("r.text"))
    return left.join(right, same & (F.col("r.first") < F.col("l.id")), "left_semi")


def combinations(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``part, mask, n, good, toxic``: rows of each part that fail exactly the filters of ``mask``
    (bit 0 is A), and how many of them are labelled good and toxic."""
    texts = _texts(docs, id_col, text_col, lang_col)
    facts = written(texts.select("id", "part", "h", _failures(F.col("text")).alias("mask")), "audit-facts")
    repeated = facts.where("id IS NOT NULL").groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b"))
    repeated = written(repeated.where("a < b").select("h", "n"), "audit-repeated")
    marked = copies(texts, repeated, facts.count()).select("id", "part", _failures(F.col("text")).alias("mask"))
    # A marked row leaves the combination without E and joins the one with it.
    moves = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.lit(-1).alias("n")), F.struct(F.col("mask").bitwiseOR(_E).alias("mask"), F.lit(1).alias("n"))))
    moved = marked.select("id", "part", moves.alias("m")).select("id", "part", "m.mask", "m.n")
    rows = written(facts.select("id", "part", "mask", F.lit(1).alias("n")).unionByName(moved), "audit-failures")
    label = labels.select(quoted(id_col).cast("long").alias("id"), *[(quoted(c) == 1).cast("int").alias(c) for c in ("quality", "toxic")])
    label = label.where("id IS NOT NULL").groupBy("id").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("quality", "toxic")])
    counted = rows.groupBy("part", "mask").agg(F.sum("n").alias("n")).select("*", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    labelled = rows.join(label, "id").groupBy("part", "mask").agg(F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    both = counted.unionByName(labelled.select("part", "mask", F.lit(0).cast("long").alias("n"), "good", "toxic"))
    return both.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def _steps() -> list[dict]:
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            out.append({"filter_order": "".join(order), "step": step, "bit": bit, "before": before})
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row for each part, order and step, zeros included; see the module for what counts.

    ``kept`` after the step, ``removed`` by it, ``redundant`` (removed earlier, failing here too),
    ``unique_fails`` (failing this filter alone), ``good_lost`` and ``toxic_lost`` (removed here),
    ``shapley`` (what the step's filter removes, summed over all 120 orders).
    """
    steps = F.from_json(F.lit(json.dumps(_steps())), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    each = combinations(docs, labels, **columns).select("*", F.explode(steps).alias("s")).select("part", "mask", "n", "good", "toxic", "s.*")
    mask, bit, before = F.col("mask"), F.col("bit"), F.col("before")
    fails, earlier = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0

    def total(condition: Column, value: str) -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(0)).cast("long").alias(value)

    # Among the filters that a row fails, each comes first in equally many of the 120 orders.
    share = F.when(fails, F.expr(f"n * ({len(_steps()) // len(FILTERS)} div bit_count(mask))")).otherwise(0)
    return each.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier, "n").alias("kept"),
        total(fails & ~earlier, "n").alias("removed"),
        total(fails & earlier, "n").alias("redundant"),
        total(mask == bit, "n").alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"),
        total(fails & ~earlier, "toxic").alias("toxic_lost"),
        F.sum(share).cast("long").alias("shapley"),
    )
