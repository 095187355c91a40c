from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from linetally.session import build_session  # noqa: E402
from linetally.sources.corpus import as_corpus  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "linetally-tests",
        master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def corpus(spark):
    """Build a corpus from ``{path: content}`` or ``[(root, path, content)]``."""

    def build(files):
        rows = [("main", p, c) for p, c in files.items()] if isinstance(files, dict) else list(files)
        return as_corpus(spark.createDataFrame(rows, "root string, path string, content string"))

    return build
