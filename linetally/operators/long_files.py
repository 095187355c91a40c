"""Counters of files that are cut into blocks of whole lines.

What a line means depends on what is open where it begins: nothing, a block comment or a
string. A block is therefore scanned once for every possible beginning, which gives a small
map: from each beginning to the counters and to what is open at the end. Maps of
consecutive blocks compose, whatever their number, so one file is work for many tasks; the
counters of a file are those of the composed map that begins with nothing open.

    blocks(root STRING, path STRING, block_no BIGINT, content STRING [, valid_utf8 BOOLEAN])

Blocks are numbered from 0 without gaps, and all but the last of a file end with a line end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linetally.functions import lexer
from linetally.functions.language import language_sql, style_sql
from linetally.operators.stats import COUNTERS

#: What may be open at a line start, by comment style; nothing is open in state 0.
OPENERS = {
    "c": ["", "/*", '"', "'", "`"],
    "p": ["", '"""', "'''", '"', "'", "`"],
    "h": ["", "<!--", '"', "'", "`"],
    "n": ["", '"', "'", "`"],
}
#: Blocks whose maps are composed in one step, and the steps: up to 10^9 blocks a file.
RUN = 1000
LEVELS = 3
KEY = ["root", "path"]


def split_blocks(files: DataFrame, lines: int) -> DataFrame:
    """Blocks of so many lines, cut from the contents of a corpus."""
    pieces = F.regexp_extract_all("content", F.lit(rf"(?:[^\n]*+\n){{1,{lines}}}+|[^\n]++\z"), F.lit(0))
    whole = F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.lit("")))
    cut = files.select(*KEY, F.posexplode(whole).alias("block_no", "content"))
    return cut.withColumn("block_no", F.col("block_no").cast("bigint"))


def _text(s: str) -> str:
    return "'" + s.replace("'", "\\'") + "'"


def _beginnings(style: str) -> str:
    """``ARRAY<STRUCT<state, opener>>`` of a style; the first block of a file has only state 0."""

    def listed(s: str) -> str:
        return "array(" + ", ".join(f"struct({i} AS state, {_text(o)} AS opener)" for i, o in enumerate(OPENERS[s])) + ")"

    by_style = " ".join(f"WHEN '{s}' THEN {listed(s)}" for s in "cph")
    return f"slice(CASE {style} {by_style} ELSE {listed('n')} END, 1, CASE WHEN block_no = 0 THEN 1 ELSE 6 END)"


def _end_state(pieces: str, style: str) -> str:
    """What is open behind the last chunk: an unclosed comment or string, or nothing."""
    last = f"element_at({pieces}, -1)"

    def closed(opener: str) -> str:
        if opener == "<!--":
            return f"contains(substring({last}, 5), '-->')"
        end = "*/" if opener == "/*" else opener
        if len(opener) > 1:
            return f"(endswith({last}, {_text(end)}) AND length({last}) >= {len(opener) + len(end)})"
        return f"regexp_like({last}, {lexer.raw(rf'\A{opener}[^{opener}\\]*+(?:\\\r*[\s\S][^{opener}\\]*+)*+{opener}\z')})"

    def of(s: str) -> str:
        # Longer openers are tested first, as they begin with shorter ones.
        order = sorted(enumerate(OPENERS[s]), key=lambda x: -len(x[1]))
        tests = " ".join(f"WHEN startswith({last}, {_text(o)}) THEN CASE WHEN {closed(o)} THEN 0 ELSE {i} END" for i, o in order if o)
        return f"CASE {tests} ELSE 0 END"

    by_style = " ".join(f"WHEN '{s}' THEN {of(s)}" for s in "cph")
    return f"CASE WHEN size({pieces}) = 0 THEN 0 ELSE CASE {style} {by_style} ELSE {of('n')} END END"


def block_maps(blocks: DataFrame) -> DataFrame:
    """``root, path, no, maps``: for each state that a block may begin in, the state at its end and
    its counters. One scan of the block for each state, no shuffle.

    An opener and a line end are put in front of the text; that line is taken off again.
    """
    styled = blocks.selectExpr(*KEY, "block_no AS no", "content", f"{style_sql('path')} AS _style")
    begun = styled.selectExpr(*KEY, "no", "content", "_style", f"inline({_beginnings('_style').replace('block_no', 'no')})")
    text = begun.selectExpr("*", "CASE WHEN state = 0 THEN content ELSE opener || '\n' || content END AS _text")
    cut = text.selectExpr("*", f"{lexer.chunks('_text', '_style')} AS _chunks")
    shapes = cut.selectExpr(
        "*",
        f"{lexer.skeleton('_chunks', '_style')} AS _skeleton",
        f"{lexer.code_text('_chunks', '_style')} AS _code",
        f"{lexer.note_text('_chunks', '_style')} AS _notes",
    )
    comment = "CASE WHEN opener IN ('/*', '\"\"\"', '\\'\\'\\'', '<!--') THEN 1 ELSE 0 END"
    code = "CASE WHEN opener IN ('\"', '\\'', '`') THEN 1 ELSE 0 END"
    counted = shapes.selectExpr(
        *KEY,
        "no",
        "state",
        f"{_end_state('_chunks', '_style')} AS end",
        f"{lexer.line_count('content')} AS lines",
        f"{lexer.comment_lines('_skeleton')} - {comment} AS comment_lines",
        f"{lexer.code_lines('_skeleton')} - {code} AS code_lines",
        f"{lexer.complexity('_code')} AS complexity",
        f"{lexer.todo_count('_notes')} AS todo_count",
        f"{lexer.secret_count('_text', '_chunks', '_style')} AS secrets_found",
    )
    sums = ["lines", "comment_lines", "code_lines", "complexity", "todo_count", "secrets_found"]
    one = F.struct("state", "end", *sums)
    return counted.groupBy(*KEY, "no").agg(F.array_sort(F.collect_list(one)).alias("maps"))


_SUMS = ["lines", "comment_lines", "code_lines", "complexity", "todo_count", "secrets_found"]


def _composed(maps: DataFrame) -> DataFrame:
    """Maps of runs of ``RUN`` consecutive blocks (or runs), numbered in their turn."""
    runs = maps.groupBy(*KEY, F.floor(F.col("no") / RUN).alias("run")).agg(F.array_sort(F.collect_list(F.struct("no", "maps"))).alias("parts"))
    rest = F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0)))

    def through(first: Column) -> Column:
        """One beginning of the run: from the first part's map on through all others."""

        def step(done: Column, part: Column) -> Column:
            here = F.element_at(part["maps"], done["end"] + 1)
            return F.struct(done["state"].alias("state"), here["end"].alias("end"), *[(done[c] + here[c]).alias(c) for c in _SUMS])

        return F.aggregate(rest, first, step)

    return runs.select(*KEY, F.col("run").alias("no"), F.transform(F.col("parts")[0]["maps"], through).alias("maps"))


def block_stats(blocks: DataFrame) -> DataFrame:
    """Statistics of whole files from their blocks: the counters of ``stats.file_stats``.

    ``path, root, language, size_bytes`` and the counters, and ``valid_utf8`` if blocks have it. Only
    maps are shuffled; a row has the maps of at most ``RUN`` blocks.
    """
    composed = reduce(lambda maps, _: _composed(maps), range(LEVELS), block_maps(blocks))
    whole = composed.select(*KEY, F.col("maps")[0].alias("whole"))
    valid = [F.bool_and("valid_utf8").alias("valid_utf8")] if "valid_utf8" in blocks.columns else []
    language = F.when(F.col("block_no") == 0, F.expr(language_sql("path", "content")))
    facts = blocks.select(*KEY, language.alias("language"), F.octet_length("content").cast("bigint").alias("size_bytes"), *[c for c in ("valid_utf8",) if valid])
    facts = facts.groupBy(*KEY).agg(F.max("language").alias("language"), F.sum("size_bytes").alias("size_bytes"), *valid)
    counters = {c: F.col(f"whole.{c}") for c in _SUMS}
    counters["blank_lines"] = counters["lines"] - counters["comment_lines"] - counters["code_lines"]
    return whole.join(facts, KEY).select("path", "root", "language", *[counters[c].alias(c) for c in COUNTERS], "size_bytes", *[c for c in ("valid_utf8",) if valid])
