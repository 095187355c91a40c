from __future__ import annotations

import json

from linetally.operators import artifacts


def test_dependency_counts(corpus):
    files = corpus(
        {
            "a/Cargo.lock": "# x\n[[package]]\nname = 'a'\n  [[package]]  \n[package]\n",
            "b/requirements.txt": "# c\n\na==1\n  b\n   # d\n",
            "v3/package-lock.json": json.dumps({"packages": {"": {}, "node_modules/a": {}, "node_modules/b": {}}, "dependencies": {"z": {}}}),
            "empty/package-lock.json": json.dumps({"packages": {}}),
            "v1/package-lock.json": json.dumps(
                {"dependencies": {"a": {"dependencies": {"b": {"dependencies": {"c": {}}}, "d": {}}}, "e": {"requires": {"f": "1"}}}}
            ),
            "none/package-lock.json": "{}",
            "bad/package-lock.json": "{",
            "x/cargo.lock": "[[package]]\n",
        }
    )
    found = {r["path"]: r["dependencies"] for r in artifacts.dependency_counts(files).collect()}
    assert found == {
        "a/Cargo.lock": 2,
        "b/requirements.txt": 2,
        "v3/package-lock.json": 2,
        "empty/package-lock.json": 0,
        "v1/package-lock.json": 5,
        "none/package-lock.json": 0,
    }


def test_deeply_nested_lock_file(corpus):
    def nested(levels):
        deep = "{}"
        for _ in range(levels):
            deep = '{"dependencies": {"a": %s}}' % deep
        return deep

    files = corpus({"d/package-lock.json": nested(60), "e/package-lock.json": nested(200)})
    found = {r["path"]: r["dependencies"] for r in artifacts.dependency_counts(files).collect()}
    assert found == {"d/package-lock.json": 60}  # a document of over 127 levels is refused


def test_coverage_rates(corpus):
    files = corpus(
        {
            "ok.xml": '<?xml?>\n<coverage version="1"\n line-rate="0.875" x="1"><coverage line-rate="0.1">',
            "text.xml": '<coverage line-rate="high">',
            "none.xml": "<report/>",
        }
    )
    found = {r["path"]: (r["status"], r["line_coverage"]) for r in artifacts.coverage_rates(files).collect()}
    assert found == {"ok.xml": ("ok", 87.5), "text.xml": ("not a number", None), "none.xml": ("missing", None)}


def test_routes_and_documents(corpus):
    source = "@app.get('/a')\n@app.post(\"/a\")\n@app.get('/a')\n@app.get('/b')\n@app.head('/c')\n"
    files = corpus({"m.py": source, "n.py": "@app.get('/a')\n", "m.js": "@app.get('/js')\n"})
    routes = artifacts.api_routes(files)
    assert sorted((r["route"], r["method"]) for r in routes.collect()) == [("/a", "get"), ("/a", "post"), ("/b", "get")]
    documents = artifacts.openapi_documents(routes).collect()
    assert len(documents) == 1
    document = json.loads(documents[0]["document"])
    assert document["openapi"] == "3.0.0" and document["info"] == {"title": "Auto-generated API", "version": "1.0.0"}
    assert list(document["paths"]) == ["/a", "/b"] and set(document["paths"]["/a"]) == {"get", "post"}
    assert document["paths"]["/b"]["get"] == {
        "summary": "Auto-generated /b route",
        "responses": {"200": {"description": "Successful response"}},
    }
