"""Run every registered query beside its SQL twin and compare rows.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        column = frame[name]
        if str(column.dtype).startswith("datetime"):
            column = column.dt.tz_localize(None) if getattr(column.dt, "tz", None) else column
            frame[name] = column.astype("datetime64[us]").astype(str)
        elif column.dtype == object or str(column.dtype) in ("string", "str"):
            frame[name] = column.map(lambda v: "<null>" if v is None or v is pd.NA or v != v else str(v))
        elif str(column.dtype).startswith("float"):
            frame[name] = column.map(lambda v: "<null>" if v != v else repr(float(v)))
        else:
            frame[name] = column.astype(str)
    return frame.sort_values(list(frame.columns), kind="stable").reset_index(drop=True)


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    def kind(dtype) -> str:
        text = str(dtype).lower()
        return "float" if text.startswith("float") else "text" if text in ("object", "string", "str") else text[:8]

    return {name: kind(frame[name].dtype) for name in sorted(frame.columns)}


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} != {len(sql_frame)}"
    left, right = canonical(spark_frame), canonical(sql_frame)
    wrong = (left != right).any(axis=1)
    if wrong.any():
        row = wrong.idxmax()
        return f"{int(wrong.sum())} rows differ, first:\n  spark {dict(left.loc[row])}\n  sql   {dict(right.loc[row])}"
    if kinds(spark_frame) != kinds(sql_frame):
        return f"types {kinds(spark_frame)} != {kinds(sql_frame)}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from linetally.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = build_session(
        master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle, failed = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            result = run(spark, sf_dir).toPandas()
            took = time.time() - start
            if name not in oracle:
                print(f"----  {name}: {len(result)} rows, no SQL ({took:.1f}s)", flush=True)
                continue
            start = time.time()
            expected = con.execute(oracle[name]).df()
            message = difference(result, expected)
            sql_took = time.time() - start
        except Exception as error:  # report and go on with the next query
            failed += 1
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
            continue
        failed += message is not None
        verdict = "ok   " if message is None else "DIFF "
        print(f"{verdict} {name}: {len(result)} rows ({took:.1f}s, sql {sql_took:.1f}s) {message or ''}", flush=True)
    print(f"failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
