"""Counts and tables read from special files: lock files, coverage reports, routes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from linetally.functions.analysis import is_ext
from linetally.functions.paths import base_name
from linetally.functions.text import lines, utrim
from linetally.operators.rows import explode_once
from linetally.operators.rules import sharded
from linetally.sources.corpus import readable

# Lock-file names and the patterns of coverage and route lines.
CARGO_LOCK, NPM_LOCK, PIP_FILE = "Cargo.lock", "package-lock.json", "requirements.txt"
CARGO_ENTRY = "[[package]]"
COVERAGE = r'<coverage[^>]*line-rate="([^"]+)"'
ROUTE = r"""@app\.(get|post|put|delete|patch)\(["']([^"']+)["']\)"""
OPENAPI_VERSION = "3.0.0"


#: Levels of nesting from which a JSON document is refused.
MOST_LEVELS = 127


def _refuse(constant: str):
    raise ValueError(constant)


def _npm_packages(document: str | None) -> int | None:
    if document is None:
        return None
    try:
        lock = json.loads(document, parse_constant=_refuse)  # NaN and Infinity are no JSON
    except (ValueError, RecursionError):
        return None
    level = [lock]
    for _ in range(MOST_LEVELS):
        level = [y for x in level if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)]
    if any(isinstance(x, (dict, list)) for x in level):
        return None
    if not isinstance(lock, dict):
        return 0
    if isinstance(lock.get("packages"), dict):
        return max(len(lock["packages"]) - 1, 0)  # the entry "" is the project itself
    total, open_nodes = 0, [lock]
    while open_nodes:
        nested = open_nodes.pop()
        below = nested.get("dependencies") if isinstance(nested, dict) else None
        if isinstance(below, dict):
            total += len(below)
            open_nodes.extend(below.values())
    return total


@F.pandas_udf(LongType())
def npm_packages(documents: pd.Series) -> pd.Series:
    """Packages in npm lock files of any version; null for malformed JSON.

    Old lock files nest to any depth, which no fixed expression covers. NaN, Infinity and
    documents of more than ``MOST_LEVELS`` levels are malformed.
    """
    return pd.Series([_npm_packages(d) for d in documents], dtype="Int64")


def dependency_counts(files: DataFrame) -> DataFrame:
    """``root, path, kind, dependencies`` for Cargo, npm and pip files.

    Names match case-sensitively; an npm lock with malformed JSON yields no row.
    """
    name = base_name(F.col("path"))
    named = readable(files).withColumn("kind", name)
    rows = F.transform(lines(F.col("content")), utrim)
    simple = named.filter(name.isin(CARGO_LOCK, PIP_FILE)).select(
        "root",
        "path",
        "kind",
        F.when(F.col("kind") == CARGO_LOCK, F.size(F.filter(rows, lambda r: r == CARGO_ENTRY)))
        .otherwise(F.size(F.filter(rows, lambda r: (r != "") & ~r.startswith("#"))))
        .cast("bigint")
        .alias("dependencies"),
    )
    npm = named.filter(name == NPM_LOCK).select("root", "path", "kind", npm_packages("content").alias("dependencies"))
    return simple.unionByName(npm.filter("dependencies IS NOT NULL"))


def coverage_rates(files: DataFrame) -> DataFrame:
    """``root, path, status, line_coverage``: first line rate of each coverage document, in
    percent. Status is ``ok``, ``not a number`` or ``missing``."""
    found = files.select("root", "path", F.regexp_extract_all("content", F.lit(COVERAGE), F.lit(1)).alias("rates"))
    rate = F.get("rates", F.lit(0))
    value = rate.try_cast("double")
    return found.select(
        "root",
        "path",
        F.when(rate.isNull(), F.lit("missing")).when(value.isNull(), F.lit("not a number")).otherwise(F.lit("ok")).alias("status"),
        (value * F.lit(100.0)).alias("line_coverage"),
    )


def api_routes(files: DataFrame) -> DataFrame:
    """Distinct ``root, route, method`` of route decorators in .py files."""
    source = readable(files).filter(is_ext(F.col("path"), "py"))

    def group(i: int) -> Column:
        return F.regexp_extract_all("content", F.lit(ROUTE), F.lit(i))

    pairs = F.arrays_zip(group(1).alias("method"), group(2).alias("route"))
    rows = explode_once(source.select("root", pairs.alias("pairs")), "pairs", "p")
    return rows.select("root", "p.route", F.lower("p.method").alias("method")).distinct()


OPENAPI_METHODS = "map<string,struct<summary:string,responses:map<string,struct<description:string>>>>"


def openapi_routes(routes: DataFrame) -> DataFrame:
    """``root, route, methods``: all methods of a route as one map. Summaries and responses are fixed texts."""
    answer = F.create_map(F.lit("200"), F.struct(F.lit("Successful response").alias("description")))
    operation = F.struct(
        F.format_string("Auto-generated %s route", "route").alias("summary"), answer.alias("responses")
    )
    return (
        routes.groupBy("root", "route")
        .agg(F.array_sort(F.collect_set("method")).alias("names"))
        .select(
            "root",
            "route",
            F.map_from_entries(F.transform("names", lambda m: F.struct(m, operation))).alias("methods"),
        )
    )


def openapi_frame() -> list[Column]:
    """The fields in front of the paths; the title is a fixed text."""
    info = F.struct(F.lit("Auto-generated API").alias("title"), F.lit("1.0.0").alias("version"))
    return [F.lit(OPENAPI_VERSION).alias("openapi"), info.alias("info")]


def openapi_documents(routes: DataFrame, documents: int = 1) -> DataFrame:
    """OpenAPI skeletons as values: ``root, shard, document``.

    Each root has up to ``documents`` of them, over which its routes are spread; all methods
    of a route stay together. For roots of any size see ``sinks.fragments.write_openapi``.
    """
    grouped = (
        sharded(openapi_routes(routes), "root", "route", documents)
        .groupBy("root", "shard")
        .agg(F.collect_list(F.struct("route", "methods")).alias("entries"))
    )
    by_route = F.array_sort("entries", lambda a, b: F.when(a["route"] < b["route"], -1).when(a["route"] > b["route"], 1).otherwise(0))
    body = F.struct(*openapi_frame(), F.map_from_entries(by_route).alias("paths"))
    return grouped.select("root", "shard", F.to_json(body).alias("document"))
