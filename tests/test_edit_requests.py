"""The piece table against string edits, and requests of every kind with their guards."""

import hashlib
import random

import pytest

from corposcope.errors import EngineError
from corposcope.functions import handles
from corposcope.operators import edit_requests
from corposcope.operators.edit_requests import Pieces, line_offset, plan_request
from corposcope.plans.workspace import Workspace

A = "def f():\n    return 1\n\n\ndef g():\n    return f()\n"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def handle(path, a, b, text, workspace="main"):
    import base64
    import json

    body = json.dumps({"w": workspace, "p": path, "a": a, "b": b, "h": sha(text)}).encode()
    return "range:" + base64.urlsafe_b64encode(body).decode().rstrip("=")


def change(**given):
    return {**dict.fromkeys(edit_requests.COLUMNS), "seq": 1, "snapshot_id": "s", **given}


def plan(stored, *changes, snapshot="s", extractor="code"):
    return plan_request([change(**c) for c in changes], stored, "main", snapshot, extractor)


def test_pieces_follow_string_edits():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("ab\né") for _ in range(rng.randint(0, 12)))
        pieces = Pieces(text)
        for _ in range(rng.randint(1, 6)):
            cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randint(1, 2))))
            ranges = list(zip(cuts[::2], cuts[1::2])) or [(cuts[0], cuts[0])]
            new = rng.choice(["", "X", "YZ\n"])
            for a, b in reversed(ranges):
                text = text[:a] + new + text[b:]
            pieces.replace(ranges, new)
            if rng.random() < 0.5:
                assert pieces.text() == text
        assert pieces.text() == text


def test_line_offsets():
    assert [line_offset("a\nbc\n", n) for n in (0, 1, 2, 3, 4)] == [0, 0, 2, 5, 5] and line_offset("", 3) == 0


def test_every_kind_in_one_request():
    rows = plan(
        {"a.py": A, "b.txt": "old\r\n", "c.txt": "gone"},
        {"kind": "insert", "path": "a.py", "anchor_symbol": "f", "position": "after", "content": "# between\n"},
        {"kind": "insert", "path": "a.py", "anchor_symbol": "g", "position": "inside_start", "content": "    # in\n"},
        {"kind": "replace", "path": "a.py", "old_text": "return 1\n", "new_text": "return 2"},
        {"kind": "rename", "path": "a.py", "to": "d.py"},
        {"kind": "create", "path": "b.txt", "content": "new\ntext\n", "overwrite": True},
        {"kind": "delete", "path": "c.txt"},
        {"kind": "create", "path": "e.txt", "content": "fresh"},
    )
    assert rows == [
        ["a.py", A, None, None], ["b.txt", "old\r\n", "new\r\ntext\r\n", None], ["c.txt", "gone", None, None],
        ["d.py", None, "def f():\n    return 2\n# between\n\n\ndef g():\n    # in\n    return f()\n", None], ["e.txt", None, "fresh", None],
    ]


REPLACE = {"kind": "replace", "path": "a.py", "old_text": "return 1", "new_text": "x"}


@pytest.mark.parametrize("changes,code", [
    ([{**REPLACE, "snapshot_id": None}], "MISSING_PRECONDITION"),
    ([{**REPLACE, "snapshot_id": "older"}], "STALE_SNAPSHOT"),
    ([{**REPLACE, "snapshot_id": "older", "expected_hash": sha(A)}], None),
    ([{**REPLACE, "expected_hash": sha("other")}], "STALE_FILE"),
    ([{"kind": "create", "path": "n", "content": "", "snapshot_id": "older"}], None),
    ([{"kind": "create", "path": "a.py", "content": ""}], "PATH_EXISTS"),
    ([{**REPLACE, "old_text": "return"}], "EXACT_MATCH_COUNT"),
    ([{**REPLACE, "old_text": "return", "expected_replacements": 2}], None),
    ([REPLACE, {**REPLACE, "old_text": "return 1\n\n"}], "OVERLAPPING_EDITS"),
    ([REPLACE, {**REPLACE, "old_text": "return f()"}], None),
    ([{**REPLACE, "path": "gone"}], "PATH_NOT_INDEXED"),
    ([{"kind": "delete", "path": "gone"}], "PATH_NOT_FOUND"),
    ([{"kind": "rename", "path": "a.py", "to": "b"}], "PATH_EXISTS"),
    ([{"kind": "delete", "path": "b"}, {"kind": "rename", "path": "a.py", "to": "b"}], "PATH_EXISTS"),
    ([{"kind": "create", "path": "../x", "content": ""}], "OUTSIDE_ROOT"),
    ([{"kind": "insert", "path": "a.py", "anchor_symbol": "h", "position": "after", "content": "x"}], "SYMBOL_NOT_FOUND"),
    ([{"kind": "replace_range", "path": "a.py", "new_text": "x"}], "MISSING_HANDLE"),
    ([{"kind": "replace_range", "path": "a.py", "new_text": "x", "handle": "range:###"}], "INVALID_HANDLE"),
    ([{"kind": "replace_range", "path": "a.py", "new_text": "x", "handle": handle("a.py", 1, 2, A, "other")}], "INVALID_HANDLE"),
    ([{"kind": "replace_range", "path": "a.py", "new_text": "x", "handle": handle("a.py", 3, 2, A)}], "INVALID_HANDLE_RANGE"),
    ([{"kind": "replace_range", "path": "a.py", "new_text": "x", "handle": handle("a.py", 1, 2, "old")}], "STALE_FILE"),
    ([{"kind": "replace_range", "path": "a.py", "new_text": "x", "handle": handle("a.py", 1, 2, A), "snapshot_id": "older"}], None),
    ([{"kind": "replace_range", "path": "a.py", "new_text": "x", "handle": handle("a.py", 1, 2, A)}, {"kind": "delete", "path": "a.py"}], "AMBIGUOUS_HANDLE_EDIT_ORDER"),
    ([{**REPLACE, "handle": handle("a.py", 5, 6, A)}], "EXACT_MATCH_COUNT"),
    ([{**REPLACE, "handle": handle("a.py", 1, 2, A), "snapshot_id": None}], None),
    ([{"kind": "move", "path": "a.py"}], "INVALID_CHANGE_KIND")])
def test_guards(changes, code):
    rows = plan({"a.py": A, "b": "x"}, *changes)
    assert (rows[0][3] == code and len(rows) == 1) if code else all(r[3] is None for r in rows)


def test_replaced_lines_keep_their_line_end():
    rows = plan({"a": "one\r\ntwo\r\nthree"}, {"kind": "replace_range", "path": "a", "new_text": "x\ny", "handle": handle("a", 1, 2, "one\r\ntwo\r\nthree")})
    assert rows == [["a", "one\r\ntwo\r\nthree", "x\r\ny\r\nthree", None]]


def test_requests_are_apart_and_ordered(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "path STRING, content STRING")
    rows = [("t1", 2, "replace", "a", "1", "2", "s"), ("t1", 1, "rename", "b", None, None, "s"), ("t2", 1, "delete", "a", None, None, "s"), (None, 1, "delete", "c", None, None, "s"), ("t3", 1, "delete", "b", None, None, None)]
    df = spark.createDataFrame(rows, "txn STRING, seq INT, kind STRING, path STRING, old_text STRING, new_text STRING, snapshot_id STRING")
    from pyspark.sql import functions as F

    got = edit_requests.plan_requests(df.withColumn("to", F.when(F.col("kind") == "rename", "d\\e")), files, snapshot="s").collect()
    assert sorted(tuple(r) for r in got if r.txn == "t1") == [("t1", "a", "1", "2", None), ("t1", "b", "2", None, None), ("t1", "d/e", None, "2", None)]
    assert {(r.txn, r.path, r.error) for r in got if r.txn != "t1"} == {("t2", "a", None), ("", "c", "PATH_NOT_FOUND"), ("t3", "b", "MISSING_PRECONDITION")}
    assert edit_requests.plan_requests(df.limit(0), files).collect() == []


def test_workspace_plans_an_edit(spark, corpus):
    ws = Workspace(spark, corpus({"a.py": A, "b.txt": "x\n"}), extractor="code")
    found = ws.retrieve([{"operation": "read", "target": "symbol", "value": "f"}]).results["op_1"].first()
    out = ws.plan_edit([{"kind": "replace_range", "path": "a.py", "handle": found.handle, "new_text": "def f():\n    return 3"}, {"kind": "create", "path": "n.py", "content": "x = 1\n"}]).collect()
    assert [(r.path, r.error, r.added, r.removed) for r in out] == [("a.py", None, 1, 1), ("n.py", None, 1, 0)]
    assert out[0].after == A.replace("return 1", "return 3") and "+    return 3" in out[0].diff
    assert ws.plan_edit([{"kind": "delete", "path": "b.txt"}], snapshot_id=ws.snapshot_id()).first().error is None
    assert ws.plan_edit([{"kind": "delete", "path": "b.txt"}], snapshot_id="old").first().error == "STALE_SNAPSHOT"
    for bad in ([], [{"kind": "delete"}], [{"kind": "replace", "path": "a", "old_text": 5, "new_text": "x"}], ["x"]):
        with pytest.raises(EngineError):
            ws.plan_edit(bad)
    assert handles.decode_token("range:", found.handle, "X")["p"] == "a.py"


def test_diff_requests(spark, corpus):
    """Hunks by path, by the lines of one declaration, by range, by id; tokens keep their rules."""
    from corposcope.operators import hunks

    ws = Workspace(spark, corpus({"a.py": A, "b.py": "def f():\n    pass\n\n\ndef f():\n    pass\n"}), extractor="code")
    text = "".join(
        f"diff --git a/{p} b/{p}\n--- a/{p}\n+++ b/{p}\n" + "".join(f"@@ -{n},1 +{n},1 @@\n-x\n+y{n}\n" for n in (1, 2, 5, 6)) for p in ("a.py", "b.py"))
    parsed = hunks.parse(spark.createDataFrame([("d", text)], "key STRING, diff STRING"), ["key"])

    def lines(**rules):
        return [(r.path, r.new_start) for r in ws.diff_page(parsed, "s", **rules)[0].collect()]

    assert len(lines()) == 8 and lines(paths_=["a.py"], symbol="g") == [("a.py", 5), ("a.py", 6)]
    assert lines(start_line=2, end_line=4) == [("a.py", 2), ("b.py", 2)] and len(lines(start_line=2)) == 8
    one = [r.id for r in parsed.collect() if r.path == "b.py" and r.new_start == 6]
    assert lines(hunk_ids=one) == [("b.py", 6)] and lines(hunk_ids=one, start_line=1, end_line=2) == []
    for rules, code in (({"symbol": "g"}, "INVALID_REQUEST"), ({"symbol": "g", "paths_": ["a.py", "b.py"]}, "INVALID_REQUEST"), ({"symbol": "h", "paths_": ["a.py"]}, "SYMBOL_NOT_FOUND"), ({"symbol": "f", "paths_": ["b.py"]}, "AMBIGUOUS_SYMBOL")):
        with pytest.raises(EngineError) as error:
            lines(**rules)
        assert error.value.code == code
    shown, token = ws.diff_page(parsed, "s", paths_=["a.py"], max_chars=90)
    seen = [(r.path, r.new_start) for r in shown.collect()]
    while token:
        shown, token = ws.diff_page(parsed, "s", max_chars=90, continuation=token)
        seen += [(r.path, r.new_start) for r in shown.collect()]
    assert seen == [("a.py", n) for n in (1, 2, 5, 6)]
    _, token = ws.diff_page(parsed, "s", paths_=["a.py"], max_chars=90)
    with pytest.raises(EngineError) as error:
        ws.diff_page(parsed, "s", paths_=["b.py"], max_chars=90, continuation=token)
    assert error.value.code == "CONTINUATION_SCOPE_MISMATCH"
