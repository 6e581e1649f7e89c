"""Requests over a stored index: the rows of a full scan, from the paths that can hold them."""

import pytest

from corposcope.operators import index
from corposcope.operators.lookup import Stored, pushed_paths
from corposcope.plans.workspace import Workspace

FILES = {f"src/m{i:03d}.py": f"import os\nfrom a import b\n\n\ndef helper_{i}():\n    value = {i}\n    return shared_call(value)\n" for i in range(60)} | {
    "src/shared.py": "import re\n\ndef shared_call(value):\n    # needle here\n    return value\n\n\nclass Box:\n    def open(self):\n        return 1\n",
    "docs/a.md": "# Needle\nneedle\nnothing\n", "docs/z.txt": "no term of it: xneedlex\n",
}


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    corpus = spark.createDataFrame([*FILES.items(), ("docs/null.txt", None), ("docs/nul.txt", "a\0b"), ("docs/big.txt", "x" * 2_000_001), ("node_modules/x.js", "needle")], "path STRING, content STRING")
    tables = index.build(corpus, str(tmp_path_factory.mktemp("index")), extractor="code")
    return Workspace(spark, corpus, extractor="code"), Workspace.open(spark, tables, extractor="code"), tables


def rows(df):
    return sorted(map(repr, df.collect()))


REQUESTS = [
    {"operation": "search_text", "pattern": "needle"}, {"operation": "search_text", "pattern": "needle", "paths": ["docs"]}, {"operation": "search_text", "pattern": "absent term"},
    {"operation": "search_text", "pattern": r"value\s=", "syntax": "regex", "max_results": 3}, {"operation": "find_symbol", "symbol": "helper_1", "max_results": 4},
    {"operation": "find_symbol", "symbol": "OPEN"}, {"operation": "find_references", "symbol": "shared_call", "max_results": 7}, {"operation": "find_references", "symbol": "Box.open"},
    {"operation": "symbols_overview", "paths": ["src/shared.py", "gone"]}, {"operation": "read", "target": "path", "value": "src/m007.py", "start_line": 5},
    {"operation": "read", "target": "symbol", "value": "src/shared.py::shared_call", "include_imports": True}, {"operation": "find_file", "name": "m00*"},
]


def test_stored_and_scanned_answers_agree(both):
    scanned, stored, _ = both
    a, b = scanned.retrieve(REQUESTS), stored.retrieve(REQUESTS)
    assert not a.errors and not b.errors and a.results.keys() == b.results.keys()
    for key in a.results:
        assert rows(a.results[key]) == rows(b.results[key]), key
    for key in a.headers:
        assert rows(a.headers[key]) == rows(b.headers[key]), key
    assert a.results["op_1"].count() > 1 and a.results["op_3"].count() == 0


def test_paths_reach_the_scan(both):
    _, stored, _ = both
    reply = stored.retrieve([r for r in REQUESTS if r["operation"] != "find_file" and r.get("syntax") != "regex" and r.get("pattern") != "absent term" and r.get("symbol") != "Box.open"])
    for key, df in reply.results.items():
        assert pushed_paths(df), key


def test_many_paths_are_joined(both, spark, monkeypatch):
    from corposcope.operators import lookup

    scanned, _, tables = both
    monkeypatch.setattr(lookup, "MOST_PATHS", 5)
    stored = Stored.open(spark, tables)
    assert stored.with_token("shared_call").count() == 61 and stored.with_token("Box").count() == 1
    found = Workspace.open(spark, tables, extractor="code").retrieve(REQUESTS[6:7]).results["op_1"]
    assert rows(found) == rows(scanned.retrieve(REQUESTS[6:7]).results["op_1"])


def test_many_paths_send_no_text(both, spark, monkeypatch):
    from corposcope.operators import lookup

    stored = Stored.open(spark, both[2])
    asked = {
        "terms": lambda: stored.with_terms("needle value"), "token": lambda: stored.with_token("shared_call", ["src"]), "name": lambda: stored.declaring("Box.open"),
        "like": lambda: stored.symbols_like("HELPER_1", None, 9)}
    few = {k: {r.path for r in f().select("path").collect()} for k, f in asked.items()}
    monkeypatch.setattr(lookup, "MOST_PATHS", 0)
    for k, f in asked.items():
        many = f()
        plan = many._jdf.queryExecution().executedPlan().toString()
        assert few[k] <= {r.path for r in many.select("path").collect()} and "Exchange" not in plan and "Join" not in plan, k
        assert k == "like" or len(few[k]) == many.count()


def test_tables_are_built_when_asked(spark, tmp_path, corpus):
    out = index.build(corpus({"b.md": "Beta\n", "a.md": "Alpha Beta\nBeta\n"}), str(tmp_path / "ix"), tables=["symbols"])
    assert set(out) == {"files", "refused", "snapshot", "symbols"}
    assert [r.path for r in Stored.open(spark, out).first_declaring("Beta").collect()] == ["a.md"]
    assert Stored.open(spark, out).first_declaring("Gamma").count() == 0
    more = index.extend(spark, out, str(tmp_path / "ix"), index.NARROW)
    assert set(more) == set(out) | {"postings", "identifiers"} and Stored.open(spark, more).with_token("Beta").count() == 2


def test_refused_paths_have_a_reason(both, spark):
    scanned, stored, tables = both
    assert {(r.path, r.reason) for r in spark.read.parquet(tables["refused"]).collect()} == {
        ("docs/null.txt", "no_content"), ("docs/nul.txt", "binary"), ("docs/big.txt", "too_large"), ("node_modules/x.js", "excluded")}
    assert rows(scanned.files.select("path")) == rows(stored.files.select("path"))


def test_headers(both):
    reply = both[0].retrieve([{"operation": "search_text", "pattern": "value", "max_results": 5}, {"operation": "find_references", "symbol": "shared_call", "max_results": 7}, {"operation": "find_file", "name": "src", "max_results": 9}])
    head = {k: v.first().asDict() for k, v in reply.headers.items()}
    assert head["op_1"]["truncated"] and head["op_1"]["result_count"] == 5 and head["op_1"]["matched_files"] == 61
    assert head["op_2"] == {"occurrence_count": 60, "total_windows": 60, "result_count": 7, "truncated": True, "file_count": len(FILES), "byte_count": sum(len(t) for t in FILES.values())}
    assert head["op_3"] == {"total": 61, "result_count": 9, "truncated": True}


@pytest.mark.parametrize("request_", [
    {"operation": ["search_text"], "pattern": "x"}, {"operation": "find_file", "name": "a", "path": 5}, {"operation": "find_references", "symbol": "f", "definition_line": "x"},
    {"operation": "find_references", "symbol": "f", "reference_kinds": 5}, {"operation": "find_file", "name": "a", "id": ["a"]}, "search", None,
    {"operation": "read", "target": {"path": 1}, "value": "x"}, {"operation": "find_symbol", "symbol": 3}, {"operation": "search_text", "pattern": "x", "syntax": 1}])
def test_wrong_types_stay_with_their_operation(both, request_):
    reply = both[0].retrieve([request_, {"operation": "find_file", "name": "shared"}])
    assert {k: e.code for k, e in reply.errors.items()} == {"op_1": "INVALID_OPERATION_FIELD"} and list(reply.results) == ["op_2"]


def test_symbol_read(both):
    ws = both[0]

    def read(**more):
        return ws.retrieve([{"operation": "read", "target": "symbol", "id": "r", **more}])

    cut = read(value="shared_call", max_chars=5).results["r"].first()
    assert (cut.content, cut.path, cut.start_line, cut.end_line, cut.kind) == ("def s", "src/shared.py", 3, 5, "function_definition")
    rest = ws.retrieve([{"operation": "read", "target": "continuation", "value": cut.continuation}]).results["op_1"].first()
    assert cut.content + rest.content == "def shared_call(value):\n    # needle here\n    return value"
    whole = ws.retrieve([{"operation": "read", "target": "handle", "value": cut.handle}]).results["op_1"].first()
    assert whole.content == cut.content + rest.content
    full = read(value="src/m003.py::helper_3", include_imports=True, surrounding_lines=1).results["r"].first()
    assert [(i.line, i.text) for i in full.imports] == [(1, "import os"), (2, "from a import b")] and full.start_line == 4
    assert read(value="src/m003.py::gone").errors["r"].code == "SYMBOL_NOT_FOUND" and read(value="gone.py::helper_3").errors["r"].code == "SYMBOL_NOT_FOUND"


def test_lanes_follow_a_refresh(spark):
    files = spark.createDataFrame([("a/x", "1"), ("a/y", "2"), ("b", "3"), ("c", "4")], "path STRING, content STRING")
    changed = spark.createDataFrame([("a", None), ("b", "33"), ("c", "4"), ("d/e", "5"), ("gone", None)], "path STRING, content STRING")
    after = index.refresh(files, changed).select("path", "content")
    got = index.refreshed_lanes(index.snapshot_lanes(files), files, changed)
    assert rows(got) == rows(index.snapshot_lanes(after)) and after.count() == 3


def test_stored_snapshot(both):
    scanned, stored, _ = both
    assert stored.snapshot_id("h") == scanned.snapshot_id("h")
    assert "files" not in stored.stored.snapshot.inputFiles()[0].rsplit("/", 2)[-2]


def test_compact_reads(both):
    reply = both[1].retrieve([
        {"operation": "read", "target": "path", "value": "src/shared.py", "response_detail": "compact"}, {"operation": "read", "target": "symbol", "value": "shared_call", "response_detail": "compact", "include_imports": True},
        {"operation": "read", "target": "metadata", "value": "src/shared.py", "response_detail": "compact"}])
    assert {k: v.columns for k, v in reply.results.items()} == {
        "op_1": ["path", "hash", "line_ending", "content", "error"], "op_2": ["path", "hash", "line_ending", "content", "kind", "imports"],
        "op_3": ["path", "hash", "size", "language", "document_type", "line_count"]}
    assert reply.results["op_1"].first().content == FILES["src/shared.py"]
