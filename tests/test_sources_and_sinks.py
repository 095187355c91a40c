from __future__ import annotations

import csv
import json
from datetime import datetime

from pyspark.sql import functions as F

from linetally.operators import analysis, rules
from linetally.operators.incremental import incremental_scan
from linetally.operators.stats import dir_stats, file_stats, lang_stats
from linetally.sinks import reports
from linetally.sources import changelog
from linetally.sources.corpus import read_corpus, read_many, readable


def test_directory_corpus_decodes_and_marks_bad_bytes(spark, tmp_path):
    (tmp_path / "src" / "deep").mkdir(parents=True)
    (tmp_path / "src" / "a.rs").write_bytes(b"// TODO\nfn a() {}\n")
    (tmp_path / "src" / "deep" / "bad.py").write_bytes(b"x = '\xff'  # fixme\n")
    files = read_corpus(spark, str(tmp_path), "binaryFile", root="here")
    rows = {r["path"]: r for r in files.collect()}
    assert set(rows) == {"src/a.rs", "src/deep/bad.py"}
    assert rows["src/a.rs"]["valid_utf8"] and not rows["src/deep/bad.py"]["valid_utf8"]
    assert rows["src/deep/bad.py"]["content"] == "x = '�'  # fixme\n"
    assert rows["src/deep/bad.py"]["size_bytes"] == 17
    counted = {r["path"]: (r["lines"], r["todo_count"]) for r in file_stats(files).collect()}
    assert counted == {"src/a.rs": (2, 1), "src/deep/bad.py": (1, 1)}
    assert [r["path"] for r in readable(files).collect()] == ["src/a.rs"]


def test_directory_names_that_repeat_below_the_root(spark, tmp_path):
    inner = tmp_path / "data" / "x" / str(tmp_path).strip("/") / "data"
    inner.mkdir(parents=True)
    (inner / "a b.rs").write_text("x\n")
    files = read_corpus(spark, str(tmp_path / "data"), "binaryFile")
    assert [r["path"] for r in files.collect()] == [f"x/{str(tmp_path).strip('/')}/data/a b.rs"]


def test_table_corpora_are_united_by_root(spark, tmp_path):
    for root in ("one", "two"):
        spark.createDataFrame([(f"{root}\\.hidden.rs", "x\n")], "path string, content string").write.parquet(str(tmp_path / root))
    files = read_many(spark, {r: str(tmp_path / r) for r in ("one", "two")})
    assert sorted((r["root"], r["path"]) for r in files.collect()) == [("one", "one/.hidden.rs"), ("two", "two/.hidden.rs")]


def test_change_log_files(spark, tmp_path):
    log = (
        "\x1ec1\x1fAda\x1f1700000000\n\n3\t1\tsrc/a.rs\n-\t-\timg/l.png\n"
        "\x1ec2\x1f\x1f1700000060\n"
        "\x1ec3\x1fBob B\x1fnot a time\n\n10\t0\todd\tname.txt\n"
    )
    (tmp_path / "history.log").write_text(log)
    records = changelog.read_log_records(spark, str(tmp_path))
    commits = {r["commit_id"]: (r["author"], r["ts"]) for r in changelog.parse_commits(records).collect()}
    assert commits == {
        "c1": ("Ada", datetime(2023, 11, 14, 22, 13, 20)),
        "c2": (None, datetime(2023, 11, 14, 22, 14, 20)),
        "c3": ("Bob B", None),
    }
    changes = sorted(tuple(r) for r in changelog.parse_changes(records).collect())
    assert changes == [("c1", "img/l.png", 0, 0), ("c1", "src/a.rs", 3, 1), ("c3", "odd\tname.txt", 10, 0)]


def stamped(spark, rows):
    from linetally.sources.corpus import as_corpus

    return as_corpus(spark.createDataFrame(rows, "root string, path string, content string, modified_at timestamp"))


def test_incremental_scan_equals_full_scan(spark):
    old, new = datetime(2024, 1, 1), datetime(2024, 2, 1)
    before = [("m", f"f{i}.rs", "fn a() {}\n" * i, old) for i in range(20)] + [("m", "gone.rs", "x", old)]
    after = [("m", f"f{i}.rs", "fn a() {}\n" * (i if i % 4 else i + 5), old if i % 4 else new) for i in range(20)]
    after += [("m", "new.py", "# TODO\n", new), ("m", "untimed.py", "x\n", None)]
    previous = file_stats(stamped(spark, before)).withColumn("secrets_found", F.lit(99).cast("bigint"))
    result = incremental_scan(stamped(spark, after), previous)
    full = file_stats(stamped(spark, after))
    without = [c for c in full.columns if c != "secrets_found"]
    key = lambda r: r["path"]
    assert sorted(result.select(without).collect(), key=key) == sorted(full.select(without).collect(), key=key)
    reused = {r["path"] for r in result.filter("secrets_found = 99").collect()}
    assert reused == {f"f{i}.rs" for i in range(20) if i % 4}


def written(folder, suffix):
    parts = sorted(p for p in folder.rglob("part-*") if p.suffix == suffix)
    return [line for p in parts for line in p.read_text().splitlines()]


def test_written_reports_read_back_equal(spark, corpus, tmp_path):
    files = corpus({"a/x,y.rs": "// c\nfn F() {}\n", "a/b.py": "if x: pass\n", "c.md": "hi\n"})
    stats = file_stats(files).cache()

    reports.write_lang_json(stats, str(tmp_path / "lang.json"))
    stored = [json.loads(line) for line in written(tmp_path / "lang.json", ".json")]
    assert [r["language"] for r in stored] == ["Rust", "Markdown", "Python"]
    assert {r["language"]: r["lines"] for r in stored} == {r["language"]: r["lines"] for r in lang_stats(stats).collect()}

    reports.write_lang_csv(stats, str(tmp_path / "lang.csv"))
    lines = [r for r in csv.reader(written(tmp_path / "lang.csv", ".csv")) if r[0] != "Extension"]
    assert lines == [["Rust", "1", "2", "1", "1", "0"], ["Markdown", "1", "1", "1", "0", "0"], ["Python", "1", "1", "1", "0", "0"]]

    reports.write_details_csv(stats, str(tmp_path / "details.csv"))
    quoted = spark.read.option("header", True).csv(str(tmp_path / "details.csv"))
    assert {r["Path"] for r in quoted.collect()} == {"a/x,y.rs", "a/b.py", "c.md"}
    assert {r["Path"] for r in reports.details_csv_rows(stats, semicolons=True).collect()} >= {"a/x;y.rs"}

    reports.write_dir_csv(stats, str(tmp_path / "dir.csv"))
    dirs = spark.read.option("header", True).csv(str(tmp_path / "dir.csv")).collect()
    assert {(r["Directory"], r["Files"]) for r in dirs} == {(".", "1"), ("a", "2")}
    assert {r["directory"] for r in dir_stats(stats).collect()} == {".", "a"}

    found = rules.issues(stats, analysis.naming_violations(files), complexity_threshold=1.0)
    reports.write_issues_json(found, str(tmp_path / "issues.json"))
    assert sorted(r["issue_type"] for r in map(json.loads, written(tmp_path / "issues.json", ".json"))) == [
        "High Complexity",
        "Naming Violation",
    ]
    reports.write_documents(rules.sarif_documents(rules.findings(stats)), str(tmp_path / "sarif"))
    stats.unpersist()


def test_sarif_documents_are_valid_and_split(corpus):
    many = {f"f{i:03}.py": 'k = "AKIA1"\n' for i in range(120)}
    found = rules.findings(file_stats(corpus(many)))
    whole = rules.sarif_documents(found, tool="check").collect()
    assert [(r["root"], r["shard"]) for r in whole] == [("main", 0)]
    document = json.loads(whole[0]["document"])
    assert document["version"] == "2.1.0" and "$schema" in document
    driver = document["runs"][0]["tool"]["driver"]
    assert driver["name"] == "check" and [r["id"] for r in driver["rules"]] == ["CS-001", "CS-002"]
    assert len(document["runs"][0]["results"]) == 120
    split = [json.loads(r["document"]) for r in rules.sarif_documents(found, documents=5).collect()]
    uris = [
        x["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for d in split for x in d["runs"][0]["results"]
    ]
    assert len(split) > 1 and sorted(uris) == sorted(many)


def documents(folder):
    """Each root's document: its files joined in the order of their names."""
    out = {}
    for path in sorted(folder.rglob("part-*"), key=lambda p: p.name):
        out.setdefault(path.parent.name.removeprefix("root="), []).append(path.read_text())
    return {root: json.loads("".join(parts)) for root, parts in out.items()}


def test_one_document_of_a_root_of_any_size(spark, tmp_path):
    import random

    from linetally.sinks import fragments

    rng = random.Random(1)
    rows = [(root, f"d/{rng.randrange(n)},{{}}é\".py", "CS-001", "error", f"Found \"{i % 3}\"\nhere") for root, n in (("big", 800), ("one", 1), ("two", 2)) for i in range(n)]
    rows += rows[:40]  # equal findings stay as many as they are
    found = spark.createDataFrame(rows, "root string, path string, rule_id string, level string, message string").repartition(6)
    roots = spark.createDataFrame([("big",), ("none",)], "root string")
    fragments.write_sarif(found, str(tmp_path / "sarif"), tool="check", roots=roots, partitions=7)
    got = documents(tmp_path / "sarif")
    assert got.keys() == {"big", "one", "two", "none"}
    assert len(list((tmp_path / "sarif" / "root=big").glob("part-*"))) > 3
    whole = {r["root"]: json.loads(r["document"]) for r in rules.sarif_documents(found, tool="check").collect()}
    for root, document in whole.items():
        key = lambda x: json.dumps(x, sort_keys=True)
        results = [d["runs"][0].pop("results") for d in (document, got[root])]
        assert sorted(results[0], key=key) == sorted(results[1], key=key) and document == got[root]
    assert got["none"]["runs"][0]["results"] == [] and got["none"]["runs"][0]["tool"] == whole["big"]["runs"][0]["tool"]


def test_one_openapi_document_of_a_root(spark, tmp_path):
    from linetally.operators import artifacts
    from linetally.sinks import fragments

    rows = [("a", f"/p/{i}\"x", m) for i in range(200) for m in ("get", "post")[: 1 + i % 2]] + [("b", "/", "put")]
    routes = spark.createDataFrame(rows, "root string, route string, method string").repartition(5)
    fragments.write_openapi(routes, str(tmp_path / "api"), roots=spark.createDataFrame([("c",)], "root string"), partitions=5)
    got = documents(tmp_path / "api")
    whole = {r["root"]: json.loads(r["document"]) for r in artifacts.openapi_documents(routes).collect()}
    assert got.pop("c")["paths"] == {} and got == whole
