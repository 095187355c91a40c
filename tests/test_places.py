from __future__ import annotations

import pytest
from linetally.operators import filters
from linetally.operators.incremental import incremental_scan
from linetally.operators.places import BLOCK_ROWS, only_listed, with_place
from linetally.operators.stats import file_stats
from linetally.sources.corpus import as_corpus, union_roots
from pyspark.errors import PythonException


def stored(spark, tmp_path, rows, files, name="corpus"):
    """A corpus table of several Parquet files, read back with places."""
    where = str(tmp_path / name)
    df = spark.createDataFrame(rows, "path string, content string, modified_at timestamp")
    df.repartition(files).write.parquet(where)
    return as_corpus(with_place(spark.read.parquet(where)), name)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_listed_rows_of_many_files(spark, tmp_path):
    n = 3 * BLOCK_ROWS + 17
    where = str(tmp_path / "numbers")
    spark.range(n).selectExpr("id", "cast(id AS string) AS text").repartition(2, "id").write.parquet(where)
    big = with_place(spark.read.parquet(where))
    for step in (1, 2, 31, 40_000):
        keys = spark.range(0, 2 * n, step)
        kept = only_listed(big, keys, ["id"])
        assert "Exchange" not in plan(kept) and "Join" not in plan(kept)
        assert sorted(r[0] for r in kept.select("id").collect()) == list(range(0, n, step))
    assert only_listed(big, spark.range(0), ["id"]).count() == 0
    assert only_listed(big, spark.range(n, 2 * n), ["id"]).count() == 0


def test_content_is_neither_moved_nor_sent_to_python(spark, tmp_path):
    files = stored(spark, tmp_path, [(f"d/{i}.py", f"x = {i}\n", None) for i in range(40)], 4)
    changed = spark.createDataFrame([("corpus", f"d/{i}.py") for i in (3, 5, 99)] * 2, "root string, path string")
    kept = filters.uncommitted(files, changed)
    text = plan(kept)
    assert "Exchange" not in text and "Join" not in text
    udf = next(line for line in text.splitlines() if "ArrowEvalPython" in line)
    assert "content" not in udf.split("listed(", 1)[1].split(")")[0]
    assert sorted(r["path"] for r in kept.collect()) == ["d/3.py", "d/5.py"]
    # the same rows as the join of a corpus without places, repeated rows included
    twice = union_roots([files, files])
    for frame in (twice, twice.drop("place")):
        assert sorted(r["path"] for r in filters.uncommitted(frame, changed).collect()) == ["d/3.py", "d/3.py", "d/5.py", "d/5.py"]


def test_incremental_scan_reads_changed_files_where_they_lie(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [(f"{i}.py", "# TODO\n" * i, t if i % 4 else None) for i in range(20)]
    files = stored(spark, tmp_path, rows, 3)
    later = [(r["root"], r["path"], r["modified_at"]) for r in files.where("path < '15.py'").collect()]
    previous = file_stats(as_corpus(spark.createDataFrame([(p, "old", m) for _, p, m in later], "path string, content string, modified_at timestamp"), "corpus"))
    result = incremental_scan(files, previous)
    scanned = [line for line in plan(result).splitlines() if "Exchange" in line]
    assert all("content" not in line for line in scanned)
    want = {p: 1 if (p in {q for _, q, m in later if m is not None}) else i for i, (p, _, _) in enumerate(rows)}
    assert {r["path"]: r["lines"] for r in result.collect()} == want


def test_rows_without_a_place_are_an_error(spark, tmp_path):
    files = stored(spark, tmp_path, [("a.py", "x", None)], 1)
    lost = files.selectExpr("path", "root", "cast(null AS struct<file:string,row:bigint>) AS place")
    with pytest.raises(PythonException, match="place"):
        only_listed(lost, spark.createDataFrame([("corpus", "a.py")], "root string, path string"), ["root", "path"]).collect()
