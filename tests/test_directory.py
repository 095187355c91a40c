from __future__ import annotations

import io
import os
import random

import pytest
from linetally.operators.long_files import block_stats
from linetally.operators.stats import COUNTERS, file_stats
from linetally.sources import directory as D
from linetally.sources.corpus import read_corpus
from pyspark.sql import functions as F


def listed(df):
    return sorted((r["path"], r["size_bytes"]) for r in df.where("reason IS NULL").collect())


def test_trees_of_any_shape_are_listed(spark, tmp_path):
    want = []
    deep = tmp_path
    for i in range(30):
        deep = deep / f"d{i}"
    for folder, n in ((tmp_path / "flat", 500), (deep, 3), (tmp_path / ".hidden" / "_under", 2), (tmp_path, 1)):
        folder.mkdir(parents=True, exist_ok=True)
        for i in range(n):
            (folder / f"{'._'[i % 2]}f{i}.txt").write_text("x" * i)
            want.append((str((folder / f"{'._'[i % 2]}f{i}.txt").relative_to(tmp_path)), i))
    (tmp_path / "empty").mkdir()
    os.symlink(tmp_path / "flat", tmp_path / "linked")
    want += [("linked/" + p.split("/")[1], n) for p, n in want if p.startswith("flat/")]
    for names in (1, 7, 10_000):  # many rounds, some, one
        assert listed(D.list_files(spark, str(tmp_path), names)) == sorted(want)
    with pytest.raises(FileNotFoundError):
        D.list_files(spark, str(tmp_path / "nowhere"))


def test_what_is_not_read_is_told(spark, tmp_path):
    (tmp_path / "a.txt").write_text("12345")
    (tmp_path / "b.txt").write_text("1234567")
    os.mkfifo(tmp_path / "pipe")
    assert [r["path"] for r in D.read_files(spark, str(tmp_path), max_bytes=5).collect()] == ["a.txt"]
    skipped = {r["path"]: r["reason"] for r in D.skipped_files(spark, str(tmp_path), max_bytes=5).collect()}
    assert skipped == {"b.txt": "larger than 5 bytes", "pipe": "not a file"}
    assert [r["path"] for r in read_corpus(spark, str(tmp_path), "binaryFile", max_bytes=5).collect()] == ["a.txt"]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_ranges_hold_every_line_once(size):
    rng = random.Random(size)
    for _ in range(60):
        data = bytes(rng.choice(b"ab\n\n\r") for _ in range(rng.randint(0, 40)))
        parts = [D.lines_of_range(io.BytesIO(data), a, min(a + size, len(data)), step=3) for a in range(0, max(len(data), 1), size)]
        assert b"".join(parts) == data
        assert all(not p or p.endswith(b"\n") or not any(parts[i + 1 :]) for i, p in enumerate(parts))


def test_blocks_count_as_whole_files(spark, tmp_path):
    rng = random.Random(3)
    lines = ["x = 1", "/* open", "close */", '"""', "'", '"text', "# TODO", "// fixme", "<!-- a", "-->b", "", "if a && b {", "AKIA9"]
    for i, end in enumerate([".py", ".rs", ".html", ".txt"] * 3):
        (tmp_path / f"f{i}{end}").write_text("\n".join(rng.choice(lines) for _ in range(80)))
    (tmp_path / "bad.c").write_bytes(b"int a; // \xff\n" * 30)
    (tmp_path / "none.c").write_text("")
    whole = {r["path"]: r for r in file_stats(read_corpus(spark, str(tmp_path), "binaryFile", "r")).collect()}
    for size in (16, 90, 1 << 20):
        got = block_stats(D.read_blocks(spark, str(tmp_path), "r", size)).collect()
        assert {r["path"] for r in got} == whole.keys() and not next(r for r in got if r["path"] == "bad.c")["valid_utf8"]
        for r in got:
            assert [r[c] for c in ("language", *COUNTERS)] == [whole[r["path"]][c] for c in ("language", *COUNTERS)], r["path"]


def test_short_listings_are_work_for_many_tasks(spark, tmp_path, monkeypatch):
    """The rows that name what is to be read are few bytes: they must not fall into one task."""
    for i in range(40):
        (tmp_path / f"f{i}.txt").write_text("some line\n" * 50)
    for task_bytes, least in ((1 << 20, 4), (1000, 12)):
        monkeypatch.setattr(D, "TASK_BYTES", task_bytes)
        for read in (D.read_files(spark, str(tmp_path)), D.read_blocks(spark, str(tmp_path), "r", 100)):
            tasks = read.select(F.spark_partition_id().alias("task")).distinct().count()
            assert tasks >= least, (task_bytes, tasks)
