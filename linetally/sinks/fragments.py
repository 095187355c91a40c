"""JSON documents of any size: sorted fragments between a head and a tail.

A document is never a value. Its head, its entries and its tail are rows that are ordered over
all tasks and written by them; a document's files, joined in the order of their names, are
the document. One root may have tens of millions of entries: range partitioning gives each task a
stretch of them, and one task writes many small roots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linetally.operators import artifacts, rules

_HEAD, _ENTRY, _TAIL = 0, 1, 2


def document_lines(entries: DataFrame, order: Sequence[str], body: Column, head: Column, tail: Column, roots: DataFrame | None = None) -> DataFrame:
    """``root, kind, order..., value``: the lines of each root's document.

    Entries are rows of ``root`` and the ``order`` columns, sorted by these; equal ones are
    counted, so that exactly one is the first, which has no comma in front. ``roots(root)``
    adds roots whose document has no entry.
    """
    counted = entries.groupBy("root", *order).agg(F.count("*").alias("_n"))
    first = counted.groupBy("root").agg(F.min(F.struct(*order)).alias("_first"))
    marked = counted.join(first, "root")
    text = F.array_join(F.array_repeat(body, F.col("_n").cast("int")), "\n,")
    comma = F.when(F.struct(*order) == F.col("_first"), "").otherwise(",")
    rows = marked.select("root", F.lit(_ENTRY).alias("kind"), *order, F.concat(comma, text).alias("value"))
    owners = first.select("root")
    if roots is not None:
        owners = owners.unionByName(roots.select("root")).distinct()
    ends = F.explode(F.array(F.struct(F.lit(_HEAD).alias("kind"), head.alias("value")), F.struct(F.lit(_TAIL).alias("kind"), tail.alias("value"))))
    frame = owners.select("root", ends.alias("e"))
    kinds = {f.name: f.dataType for f in counted.schema.fields}
    return rows.unionByName(frame.select("root", "e.kind", *[F.lit(None).cast(kinds[c]).alias(c) for c in order], "e.value"))


def write_lines(lines: DataFrame, order: Sequence[str], location: str, partitions: int | None = None, mode: str = "errorifexists") -> None:
    """Write documents: a folder for each root, whose files in the order of their names are its document."""
    keys = ["root", "kind", *order]
    dealt = lines.repartitionByRange(partitions, *keys) if partitions else lines.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).select("root", "value").write.mode(mode).partitionBy("root").text(location)


_FINDING = ["path", "rule_id", "level", "message"]


def sarif_lines(found: DataFrame, tool: str = "linetally", roots: DataFrame | None = None) -> DataFrame:
    """The lines of one SARIF document for each root."""
    log, run = rules.sarif_frame(tool)
    # The frames are written by to_json, and the entries go in where their empty array ends.
    whole = F.to_json(F.struct(*log, F.array(run).alias("runs")))
    head, tail = F.regexp_replace(whole, r"\]\}\]\}\z", ""), F.lit("]}]}")
    return document_lines(found, _FINDING, F.to_json(rules.sarif_result()), head, tail, roots)


def write_sarif(found: DataFrame, location: str, tool: str = "linetally", roots: DataFrame | None = None, partitions: int | None = None, mode: str = "errorifexists") -> None:
    write_lines(sarif_lines(found, tool, roots), _FINDING, location, partitions, mode)


def openapi_lines(routes: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """The lines of one OpenAPI document for each root; a line has all methods of a route."""
    per_route = artifacts.openapi_routes(routes)
    body = F.regexp_replace(F.to_json(F.map_from_arrays(F.array("route"), F.array(F.from_json("methods", artifacts.OPENAPI_METHODS)))), r"\A\{|\}\z", "")
    whole = F.to_json(F.struct(*artifacts.openapi_frame(), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("paths")))
    entries = per_route.select("root", "route", F.to_json("methods").alias("methods"))
    return document_lines(entries, ["route", "methods"], body, F.regexp_replace(whole, r"\}\}\z", ""), F.lit("}}"), roots)


def write_openapi(routes: DataFrame, location: str, roots: DataFrame | None = None, partitions: int | None = None, mode: str = "errorifexists") -> None:
    write_lines(openapi_lines(routes, roots), ["route", "methods"], location, partitions, mode)
