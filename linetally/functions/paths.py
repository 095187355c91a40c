"""Path expressions. Paths use ``/``; ``normalise`` turns ``\\`` into it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def base_name_sql(path: str) -> str:
    return f"substring_index({path}, '/', -1)"


def extension_sql(path: str) -> str:
    name = base_name_sql(path)
    return f"CASE WHEN locate('.', {name}, 2) > 0 THEN substring_index({name}, '.', -1) END"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """Immediate parent directory, ``.`` for a bare file name, ``/`` right below the top."""
    cut = F.length(path) - F.length(base_name(path)) - 1
    return F.when(cut < 0, F.lit(".")).when(cut == 0, F.lit("/")).otherwise(F.substring(path, F.lit(1), cut))


def extension_of(path: Column) -> Column:
    """Text after the last dot of the file name, case kept.

    Null when there is none (``.env``, ``Makefile``), ``''`` for a trailing dot (``a.``).
    """
    name = base_name(path)
    return F.when(F.locate(".", name, 2) > 0, F.substring_index(name, ".", -1))


def components(path: Column) -> Column:
    return F.split(path, "/")
