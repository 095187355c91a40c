"""Every registered query of the library against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest
from linetally.plans.catalog import CATALOG
from linetally.plans.oracle import ORACLE as ORACLE_SQL
from oracle_check import connect, difference

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLE = {name: entry.queries()[name] for name in CATALOG}, ORACLE_SQL


@pytest.fixture(scope="module")
def database():
    return connect(SF_DIR)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
    assert set(ORACLE) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, database, name):
    assert difference(QUERIES[name](spark, SF_DIR).toPandas(), database.execute(ORACLE[name]).df()) is None


def test_entry_has_rows(spark):
    rows = entry.entry(spark).collect()
    assert rows[-1]["language"] == "Total" and rows[-1]["lines"] == sum(r["lines"] for r in rows[:-1])
