import datetime as dt

import pytest
from pyspark.sql import functions as F

from corposcope import EngineError
from corposcope.operators import changelog
from corposcope.plans import requests
from corposcope.plans.workspace import Workspace
from corposcope.streaming import reconcile, stateful

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_cursor_is_exclusive_and_newest_first(spark):
    log = spark.createDataFrame([(i, f"p{i}", "a" if i % 2 else "b") for i in range(6)], "generation BIGINT, path STRING, source STRING")
    assert [r.generation for r in changelog.changes_since(log, 3).collect()] == [5, 4]
    assert [r.generation for r in changelog.changes_since(log, 0, "a", 2).collect()] == [5, 3]


def test_group_rollup_has_twenty_rows(spark):
    rows = [(f"g{i:02d}/f{j}",) for i in range(25) for j in range(i + 1)] + [("root.txt",), ("build/x",)]
    got = changelog.changed_groups(spark.createDataFrame(rows, "path STRING")).orderBy("rank").collect()
    assert len(got) == 20 and (got[0].group, got[0].paths) == ("g24", 25)
    assert (got[19].group, got[19].paths) == ("(other)", sum(range(1, 7)) + 1)
    few = changelog.changed_groups(spark.createDataFrame(rows[:3], "path STRING")).orderBy("rank").collect()
    assert [(r.group, r.paths) for r in few] == [("g01", 2), ("g00", 1)]


def test_attribution_by_generation_and_time(spark):
    log = spark.createDataFrame([(g, f"p{g}", at(g)) for g in range(1, 8)], "generation BIGINT, path STRING, timestamp TIMESTAMP")
    runs = spark.createDataFrame([("r1", 1, 5, at(4)), ("r2", 2, 7, None)], "run_id STRING, start_generation BIGINT, end_generation BIGINT, ended_at TIMESTAMP")
    got = {(r.run_id, r.path) for r in changelog.attribute_runs(log, runs).collect()}
    assert got == {("r1", f"p{g}") for g in (2, 3, 4)} | {("r2", f"p{g}") for g in (3, 4, 5, 6, 7)}


def test_active_runs_are_never_dropped(spark):
    runs = spark.createDataFrame([(i, None if i < 3 else i) for i in range(10)], "run_id BIGINT, ended_at BIGINT")
    assert sorted(r.run_id for r in changelog.retain_runs(runs, 5).collect()) == [0, 1, 2, 8, 9]
    assert sorted(r.run_id for r in changelog.retain_runs(runs, 2).collect()) == [0, 1, 2]


def test_median_and_p95(spark):
    rows = spark.createDataFrame([("k", i, float(i)) for i in range(100)], "key STRING, t INT, v DOUBLE")
    median = changelog.lower_median(rows, "key", "v", [F.desc("t")]).first()
    assert (median.samples, median.p50) == (64, 67.0)
    assert changelog.rounded_p95(rows.filter("t < 12"), "key", "v", [F.desc("t")]).first().p95 == 10.0


@pytest.mark.parametrize("limit", [3, 1500, 100_000])
def test_tail_of_a_long_key(spark, limit):
    texts = [f"{i}-" * (i % 3) for i in range(3000)]
    rows = spark.createDataFrame([("k", i, t) for i, t in enumerate(texts)] + [("q", 0, "")], "key STRING, turn INT, text STRING")
    got = {r.key: (r.tail, r.dropped_chars) for r in changelog.retain_tail(rows, "key", "turn", "text", limit).collect()}
    whole = "".join(texts)
    assert got == {"k": (whole[-limit:], max(0, len(whole) - limit)), "q": ("", 0)}


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_feed_builds_the_snapshot(spark, corpus, tmp_path):
    state, inbox = str(tmp_path / "state"), tmp_path / "in"
    reconcile.initialise(corpus({"src/a.rs": "old", "src/deep/b.rs": "b", "docs/c.md": "c"}), state)

    def send(number, rows):
        df = spark.createDataFrame(rows, reconcile.EVENT_SCHEMA).coalesce(1)
        df.write.mode("overwrite").parquet(str(inbox / f"batch={number}"))

    def step():
        events = spark.readStream.schema(reconcile.EVENT_SCHEMA).parquet(str(inbox) + "/batch=*")
        drain(reconcile.start(events, state, str(tmp_path / "ck"), "0 seconds"))
        return {r.path: r.content for r in reconcile.current(spark, state).collect()}

    send(0, [("src/a.rs", "first", "external", at(1)), ("src/a.rs", "second", "external", at(2)), ("node_modules/x", "y", "external", at(1)),
             ("src/n.rs", "n", "internal", at(1))])
    assert step() == {"src/a.rs": "second", "src/deep/b.rs": "b", "docs/c.md": "c", "src/n.rs": "n"}
    assert reconcile.generation(spark, state) == 1
    send(1, [("src/a.rs", "second", "external", at(3))])
    step()
    assert reconcile.generation(spark, state) == 1
    send(2, [("src", None, "external", at(4))])
    assert step() == {"docs/c.md": "c"}
    log = [(r.generation, r.path, r.after_hash is None) for r in reconcile.mutations(spark, state).orderBy("generation", "path").collect()]
    assert log == [(1, "src/a.rs", False), (2, "src/a.rs", True), (2, "src/deep/b.rs", True), (2, "src/n.rs", True)]
    # A batch that runs again leaves the same state.
    reconcile.apply_batch(spark.createDataFrame([("src", None, "external", at(4))], reconcile.EVENT_SCHEMA), 2, state)
    assert reconcile.generation(spark, state) == 2
    reconcile.compact(spark, state, 2)
    assert [r.path for r in reconcile.current(spark, state).collect()] == ["docs/c.md"]


def test_own_writes_are_recognised_once_and_for_thirty_seconds(spark, tmp_path):
    rows = [("a", at(0), "write"), ("a", at(5), "watch"), ("a", at(6), "watch"), ("b", at(0), "write"), ("b", at(31), "watch"), ("c", at(1), "watch")]
    schema = "path STRING, ts TIMESTAMP, kind STRING"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = stateful.classify_origin(events).writeStream.format("memory").queryName("origins").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "ck")).start()
    drain(query)
    got = {(r.path, (r.ts - T0).seconds, r.origin) for r in spark.table("origins").collect()}
    assert got == {("a", 5, "internal"), ("a", 6, "external"), ("b", 31, "external"), ("c", 1, "external")}


def test_tail_state_across_batches(spark, tmp_path):
    schema = "run_id STRING, seq INT, text STRING"
    parts = [[("r", 1, "abc\x1b[3"), ("q", 1, "x")], [("r", 2, "1mdef\x1b]t"), ("r", 3, "itle\x07gh")]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/p={i}"))
    chunks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/p=*"))
    query = stateful.accumulate_tail(chunks, 5).writeStream.format("memory").queryName("tails").outputMode("update").option(
        "checkpointLocation", str(tmp_path / "ck")).start()
    drain(query)
    rows = [(r.run_id, r.tail, r.dropped_chars) for r in spark.table("tails").collect()]
    assert ("r", "defgh", 3) in rows and ("q", "x", 0) in rows


def test_open_sequences_stay_small():
    assert stateful.strip_chunk("a\x1b]" + "x" * 1000) == ("a", "\x1b]")
    assert stateful.strip_chunk("a\x1b]x\x1b") == ("a", "\x1b]\x1b")
    assert stateful.strip_chunk("a\x1b\x1b") == ("a", "\x1b")


@pytest.mark.parametrize("request_,code", [
    ({"operation": "nope"}, "UNSUPPORTED_RETRIEVAL_OPERATION"), ({"operation": "search_text"}, "MISSING_OPERATION_FIELD"),
    ({"operation": "search_text", "pattern": "x", "zz": 1}, "UNKNOWN_OPERATION_FIELD"), ({"operation": "find_file", "name": " "}, "INVALID_OPERATION_FIELD"),
    ({"operation": "symbols_overview"}, "MISSING_OPERATION_FIELD"), ({"operation": "repo_map", "paths": "a"}, "INVALID_OPERATION_FIELD"),
    ({"operation": "read", "target": "bash_log", "value": "x"}, "UNSUPPORTED_READ_TARGET"),
    ({"operation": "find_file", "name": "a", "response_detail": "x"}, "INVALID_OPERATION_FIELD")])
def test_closed_requests(request_, code):
    with pytest.raises(EngineError) as error:
        requests.check_operation(request_)
    assert error.value.code == code


@pytest.mark.parametrize("change,code", [
    ({}, "MISSING_CHANGE_FIELD"), ({"kind": "x"}, "UNSUPPORTED_CHANGE_KIND"), ({"kind": "delete"}, "MISSING_CHANGE_FIELD"),
    ({"kind": "delete", "path": "a", "b": 1}, "UNKNOWN_CHANGE_FIELD"),
    ({"kind": "insert", "path": "a", "content": "x", "anchor_symbol": "f", "position": "near"}, "INVALID_CHANGE_FIELD")])
def test_closed_changes(change, code):
    with pytest.raises(EngineError) as error:
        requests.check_change(change)
    assert error.value.code == code


def test_batch_isolates_errors(spark, corpus):
    ws = Workspace(spark, corpus({"src/a.py": "def f():\n    pass\n", "src/b.py": "import os\nf()\n", "AGENTS.md": "rules\n"}), extractor="code")
    reply = ws.retrieve([
        {"operation": "search_text", "pattern": "pass", "id": "s"}, {"operation": "find_references", "symbol": "absent"},
        {"operation": "find_references", "symbol": "f", "context_lines": 0}, {"operation": "find_file", "name": "b", "id": "s"},
        {"operation": "symbols_overview", "paths": ["src/a.py", "gone"]}, {"operation": "read", "target": "path", "value": "src/b.py", "start_line": 2},
        {"operation": "read", "target": "symbol", "value": "f", "surrounding_lines": 1}, {"operation": "find_file", "name": "a", "max_results": 999},
        {"operation": "read", "target": "handle", "value": "bogus"}])
    assert {k: e.code for k, e in reply.errors.items()} == {
        "op_2": "SYMBOL_NOT_FOUND", "op_4": "DUPLICATE_RETRIEVAL_OPERATION_ID", "op_9": "INVALID_HANDLE"}
    assert reply.partial_success and reply.warnings == {"op_8": "MAX_RESULTS_CLAMPED"}
    assert [r.path for r in reply.results["op_3"].collect()] == ["src/b.py"]
    assert {(r.path, r.error, r.name) for r in reply.results["op_5"].collect()} == {("src/a.py", None, "f"), ("gone", "PATH_NOT_INDEXED", None)}
    assert reply.results["op_6"].first().content == "f()"
    assert reply.results["op_7"].first().content == "def f():\n    pass"
    assert [r.path for r in ws.references_at("src/a.py", 2).collect()] == ["src/b.py"]
    assert ws.instructions().first().content == "rules\n"
    assert ws.summary().first().languages == "markdown,python"
    with pytest.raises(EngineError) as error:
        ws.retrieve([{"operation": "repo_map"}], snapshot_id="snap_old")
    assert error.value.code == "STALE_SNAPSHOT"
    assert list(ws.retrieve([{"operation": "x"}, {"operation": "repo_map"}], fail_fast=True).errors) == ["op_1"]


def test_wrong_types_are_errors_of_their_operation(spark, corpus):
    ws = Workspace(spark, corpus({"a.txt": "needle\n"}))
    reply = ws.retrieve([
        {"operation": "search_text", "pattern": "needle", "max_results": "5"}, {"operation": "search_text", "pattern": "needle", "case_sensitive": 1},
        {"operation": "search_text", "pattern": "needle"},
    ])
    assert {k: e.code for k, e in reply.errors.items()} == {"op_1": "INVALID_OPERATION_FIELD", "op_2": "INVALID_OPERATION_FIELD"}
    assert reply.results["op_3"].count() == 1


def test_one_letter_declarations_are_marked():
    from corposcope.functions import syntax

    marks = syntax._marks("f", "python", "def f():\n    f()\nasync def f(): pass\n")
    assert [m["start_byte"] for m in marks if m["role"] == "declaration"] == [4, 27]
