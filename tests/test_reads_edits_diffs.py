import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corposcope.functions import handles, linediff, syntax, text
from corposcope.operators import edits, hunks, reads, symbols


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v STRING").select(expression.alias("r")).first().r


def test_range_reads_clamp_and_resume(corpus):
    df = corpus({"a.txt": "one\ntwo\nthree\n", "é.txt": "ééé"})
    row = reads.read_range(df.filter("path = 'a.txt'"), 2, 99).first()
    assert (row.start_line, row.end_line, row.content, row.continuation) == (2, 3, "two\nthree", None)
    assert reads.read_range(df.filter("path = 'a.txt'"), 90).first().content == "three"
    cut = reads.read_range(df.filter("path = 'é.txt'"), max_chars=3)
    first = cut.first()
    assert (first.content, first.next_offset, first.total_chars) == ("é", 2, 6)
    rest = reads.read_continuations(df, cut.select("continuation")).first()
    assert (rest.content, rest.error, rest.offset) == ("éé", None, 2)
    changed = corpus({"é.txt": "éé"})
    assert reads.read_continuations(changed, cut.select("continuation")).first().error == "STALE_CONTINUATION"


def test_continuation_stays_in_its_lines(corpus):
    df = corpus({"a.txt": "one\ntwo\nthree\nfour\n"})
    cut = reads.read_range(df, 2, 3, max_chars=4)
    rest = reads.read_continuations(df, cut.select("continuation")).first()
    assert (cut.first().content, rest.content, rest.start_line, rest.end_line) == ("two\n", "three", 2, 3)


def test_handles_of_changed_missing_and_foreign_files(corpus):
    df = corpus({"a.txt": "one\ntwo\n"})
    made = lambda ws: df.select(handles.range_handle(ws, F.col("path"), F.lit(2), F.lit(2), handles.content_hash("content")).alias("handle"))
    assert reads.read_handles(df, made("main")).first().content == "two"
    assert reads.read_handles(corpus({"a.txt": "x"}), made("main")).first().error == "STALE_HANDLE"
    assert reads.read_handles(corpus({"b.txt": "x"}), made("main")).first().error == "STALE_HANDLE"
    assert reads.read_handles(df, made("other")).first().error == "INVALID_HANDLE"
    token = made("main").first().handle
    assert handles.decode_token("range:", token, "INVALID_HANDLE")["a"] == 2 and "=" not in token


def test_long_reads_by_handle_resume(corpus):
    line = "é" + "ab" * 40_000
    df = corpus({"a.txt": f"zero\n{line}\nend\n"})
    token = df.select(handles.range_handle("main", F.col("path"), F.lit(2), F.lit(3), handles.content_hash("content")).alias("handle"))
    page = reads.read_handles(df, token)
    pages, row = [page.first().content], page.first()
    resume = page.select("continuation")
    while resume.first().continuation:
        rest = reads.read_continuations(df, resume)
        pages.append(rest.first().content)
        resume = rest.select(F.col("next").alias("continuation"))
    assert (row.next_offset, row.total_chars, len(pages)) == (30_000, 80_006, 3)
    whole = reads.read_handles(df, token, whole=True).first()
    assert "".join(pages) == whole.content == f"{line}\nend" and whole.continuation is None


@pytest.mark.parametrize("value,label", [("", "none"), ("a", "none"), ("a\n", "lf"), ("a\r\n", "crlf"), ("a\r\nb\n", "mixed"), ("a\rb", "mixed")])
def test_line_ending_labels(spark, value, label):
    assert one(spark, value, text.line_ending("v")) == label


@pytest.mark.parametrize("value,plain", [
    ("\x1b[31mred\x1b[0m", "red"), ("\x1b]0;t\x07x\x1b]8;;u\x1b\\y", "xy"), ("a\x1bcb", "ab"), ("a\x1b[3", "a"), ("a\x1b]t\x1b\x1b\\b", "ab")])
def test_terminal_escapes(spark, value, plain):
    assert one(spark, value, text.strip_ansi("v")) == plain


def test_utf16_and_uris(spark):
    assert one(spark, "a😀é", text.utf16_length("v")) == 4
    assert one(spark, "a😀é", text.utf16_prefix_chars("v", F.lit(3))) == 2
    assert one(spark, "a😀é", text.utf16_prefix_chars("v", F.lit(2))) is None
    assert one(spark, "a😀é", text.utf16_prefix_chars("v", F.lit(9))) is None
    assert one(spark, "/a b/ü:*~+.py", text.file_uri("v")) == "file:///a%20b/%C3%BC:%2A~%2B.py"
    assert one(spark, "file:///a%20b+c", text.uri_to_path("v")) == "/a b+c"
    assert one(spark, "file:///a%2", text.uri_to_path("v")) is None
    assert one(spark, "http://a", text.uri_to_path("v")) is None


def test_diff_cut_on_a_character_border(spark):
    assert one(spark, "a" * 10 + "é\nnext\n", text.cap_at_newline("v", 11)) == "a" * 10
    assert one(spark, "ab\ncdef", text.cap_at_newline("v", 5)) == "ab\n"
    cut = one(spark, "é" * 300, text.truncate_with_marker("v", 100))
    assert len(cut.encode()) <= 100 and cut.endswith("… output truncated …")


def run_replace(corpus, content, old, new, expected=1):
    return edits.replace_exact(corpus({"f": content}), F.lit(old), F.lit(new), expected).first()


def test_exact_replacement(corpus):
    assert run_replace(corpus, "a b a", "a", "x", 2).after == "x b x"
    miss = run_replace(corpus, "a b a", "a", "x", 1)
    assert (miss.error, miss.actual, miss.after) == ("EXACT_MATCH_COUNT", 2, None)
    assert run_replace(corpus, "a\r\nb\r\nc\r\n", "a\nb\n", "x\ny").after == "x\r\ny\r\nc\r\n"
    assert run_replace(corpus, "a\nb\n", "a\n", "").after == "b\n"
    stale = edits.replace_exact(corpus({"f": "a"}), F.lit("a"), F.lit("b"), 1, F.lit("nope")).first()
    assert stale.error == "STALE_FILE"


@pytest.mark.parametrize("content,a,b,new,after", [
    ("1\n2\n3\n", 2, 2, "x", "1\nx\n3\n"), ("1\n2\n3", 3, 3, "x", "1\n2\nx"), ("1\n2\n3\n", 1, 9, "x", "x\n"),
    ("1\r\n2\r\n", 1, 1, "x\ny", "x\r\ny\r\n2\r\n"), ("1\n2\n", 5, 6, "x", "1\n2\nx")])
def test_line_replacement(corpus, content, a, b, new, after):
    assert edits.replace_lines(corpus({"f": content}), F.lit(a), F.lit(b), F.lit(new)).first().after == after


def test_reversed_range(corpus):
    assert edits.replace_lines(corpus({"f": "a\n"}), F.lit(2), F.lit(1), F.lit("x")).first().error == "INVALID_HANDLE_RANGE"


@pytest.mark.parametrize("position,after", [
    ("before", "#\ndef f():\n    pass\nend = 1\n"), ("after", "def f():\n    pass\n#\nend = 1\n"),
    ("inside_start", "def f():\n#\n    pass\nend = 1\n"), ("inside_end", "def f():\n#\n    pass\nend = 1\n")])
def test_insert_positions(corpus, position, after):
    df = symbols.with_symbols(corpus({"f.py": "def f():\n    pass\nend = 1\n"}), "code")
    assert edits.insert_at_symbol(df, F.lit("f"), position, F.lit("#\n")).first().after == after


def test_insert_after_the_last_line_without_newline(corpus):
    df = symbols.with_symbols(corpus({"f.py": "def f():\n    pass"}), "code")
    assert edits.insert_at_symbol(df, F.lit("f"), "after", F.lit("#")).first().after == "def f():\n    pass#"
    assert edits.insert_at_symbol(df, F.lit("g"), "after", F.lit("#")).first().error == "SYMBOL_NOT_FOUND"


def test_overlap_check(corpus):
    error = lambda *needles: edits.overlapping(corpus({"f": "abc abd"}), F.array(*map(F.lit, needles))).first().error
    assert error("abc", "bc") == "OVERLAPPING_EDITS" and error("abc", "abd") == ""
    assert error("ab", "c a") == "OVERLAPPING_EDITS" and error("zz") == ""


def test_transactions_see_earlier_changes(spark, corpus):
    files = corpus({"a": "one", "b": "two"})
    changes = spark.createDataFrame([
        ("t1", 1, "replace", "a", None, "one", "uno", 1), ("t1", 2, "rename", "a", "c", None, None, 0), ("t1", 3, "replace", "c", None, "uno", "1", 1),
        ("t2", 1, "delete", "a", None, None, None, 0), ("t2", 2, "create", "a", None, None, "new", 0),
        ("t3", 1, "rename", "a", "b", None, None, 0), ("t4", 1, "delete", "z", None, None, None, 0)],
        "txn STRING, seq INT, kind STRING, path STRING, to STRING, old_text STRING, new_text STRING, expected INT")
    rows = {(r.txn, r.path): (r.before, r.after, r.error) for r in edits.plan_transactions(changes, files).collect()}
    assert rows == {
        ("t1", "a"): ("one", None, None), ("t1", "c"): (None, "1", None), ("t2", "a"): ("one", "new", None),
        ("t3", "a"): (None, None, "PATH_EXISTS"), ("t4", "z"): (None, None, "PATH_NOT_FOUND")}


def test_syntax_gate_and_diff(corpus):
    plan = corpus({"a.py": "def f(:\n", "b.py": "x = 1\n", "c.yaml": "a: [\n", "d.json": "{}"}).withColumnRenamed("content", "after")
    assert {r.path: r.syntax_check for r in edits.syntax_gate(plan).collect()} == {
        "a.py": "SYNTAX_ERROR", "b.py": "checked", "c.yaml": "skipped", "d.json": "checked"}
    row = edits.with_diff(plan.filter("path = 'b.py'").withColumn("before", F.lit("x = 0\ny\n"))).first()
    assert (row.added, row.removed) == (1, 2) and row.diff.startswith("--- a/b.py\n+++ b/b.py\n@@ -1,2 +1 @@\n-x = 0\n-y\n+x = 1\n")


def test_changes_without_a_target_meet_in_no_join(spark, corpus):
    changes = spark.createDataFrame(
        [(f"t{i}", 1, "replace", f"p{i}", None, "x", "y", 1) for i in range(40)], "txn STRING, seq INT, kind STRING, path STRING, to STRING, old_text STRING, new_text STRING, expected INT")
    plan = edits.plan_transactions(changes, corpus({f"p{i}": "x" for i in range(40)}))
    joins = [line for line in plan._jdf.queryExecution().optimizedPlan().toString().split("\n") if "isnotnull(to#" in line]
    assert joins and sorted(r.after for r in plan.collect()) == ["y"] * 40


def test_fold_hands_texts_back_by_size():
    def batches():
        for i in range(20):
            seen.append(i)
            text = {"txn": str(i), "_step": 0, "path": "p", "content": "x" * 3_000_000}
            yield pa.RecordBatch.from_pylist([text, {"txn": str(i), "_step": 1, "path": "p", "content": None, "kind": "delete"}], names)

    names = pa.schema([("txn", pa.string()), ("_step", pa.int32()), ("path", pa.string()), ("content", pa.string()), ("kind", pa.string())])
    seen, out = [], []
    for batch in edits._fold_partition(batches()):
        out.append((len(seen), batch.num_rows))
    assert out[0][0] <= 5 and max(n for _, n in out) <= 3 and sum(n for _, n in out) == 20


@pytest.mark.parametrize("path,after,check", [
    ("a.py", "Aterth " * 20_000, "SYNTAX_ERROR"), ("a.py", "x = " + "a." * 50_000 + "a\n", "checked"), ("a.py", "x = " + "not " * 50_000 + "a\n", "skipped"),
    ("a.json", "[" * 100_000 + "]" * 100_000, "skipped"), ("a.py", "x = 1\r\n" + "No end of it " * 9_000, "SYNTAX_ERROR")])
def test_syntax_gate_beyond_the_parser(corpus, path, after, check):
    assert edits.syntax_gate(corpus({path: after}).withColumnRenamed("content", "after")).first().syntax_check == check


def test_deep_and_missing_python_texts():
    deep = "x = " + "+".join(["a"] * 2_000) + "\n"
    assert len(syntax._marks("a", "python", deep)) == 2_000
    assert syntax._marks("a", "python", "x = " + "not " * 50_000 + "a\n") == syntax._symbols("python", "Aterth " * 20_000) == []
    assert syntax._has_error("python", None) is None


def test_rename_preview_respects_boundaries(corpus):
    row = edits.rename_identifier(corpus({"a": "la lala la_x $la la."}), "la", "n$1").first()
    assert (row.after, row.edits) == ("n$1 lala la_x $la n$1.", 2)


DIFF = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -1,3 +1,4 @@ def a
 one
-two
+2
+3
@@ -10 +12,0 @@
-gone
diff --git a/y.py b/y.py
new file mode 100644
--- /dev/null
+++ b/y.py
@@ -0,0 +1 @@
+new
"""


def sequential_hunks(diff):
    out, path, header, active = [], "", "", None

    def number(part):
        return int(part) if part.isdigit() else None

    def span(field):
        field = field.lstrip("-+")
        start, _, count = field.partition(",")
        return number(start) or 0, (1 if not count and "," not in field else (number(count) if number(count) is not None else 1))

    for line in diff.splitlines(keepends=True):
        if line.startswith("diff --git "):
            if active:
                out.append((path, *active))
            active, path, header = None, "", line
            continue
        if line.startswith("+++ b/"):
            path = line[6:].rstrip()
        if line.startswith("@@ "):
            if active:
                out.append((path, *active))
            fields = line.split()
            old, new = (span(fields[i]) if len(fields) > i else (0, 0) for i in (1, 2))
            active = (*old, *new, header + line)
        elif active:
            active = (*active[:4], active[4] + line)
        else:
            header += line
    if active:
        out.append((path, *active))
    return out


def parse(spark, diff):
    df = spark.createDataFrame([(1, diff)], "k INT, diff STRING")
    rows = hunks.parse(df, ["k"]).orderBy("hunk_no").collect()
    return [(r.path, r.old_start, r.old_count, r.new_start, r.new_count, r.text) for r in rows]


def test_hunks(spark):
    assert parse(spark, DIFF) == sequential_hunks(DIFF)
    assert [h[:5] for h in parse(spark, DIFF)] == [("x.py", 1, 3, 1, 4), ("x.py", 10, 1, 12, 0), ("y.py", 0, 0, 1, 1)]


DIFF_LINES = st.lists(st.sampled_from(["diff --git a/p b/p\n", "+++ b/p\n", "+++ b/q \n", "@@ -1,2 +3 @@\n", "@@ -4 +5,6 @@ x\n", "+a\n", " b\n", "-+++ b/z\n"]), max_size=14)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(DIFF_LINES)
def test_hunks_equal_a_sequential_model(spark, lines):
    assert parse(spark, "".join(lines)) == sequential_hunks("".join(lines))


def test_hunk_pages_keep_oversized_hunks_whole(spark):
    df = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate([10, 10, 50, 5, 5])], "k INT, hunk_no INT, text STRING")
    rows = hunks.paginate(df, ["k"], 20).orderBy("hunk_no").collect()
    assert [r.page for r in rows] == [0, 0, 1, 2, 2]


STATUS = "\0".join([
    "# branch.oid abc123", "# branch.head feature/status", "1 .M N... 100644 100644 100644 aaa bbb src/changed file.rs",
    "2 R. N... 100644 100644 100644 aaa bbb R100 src/new name.rs", "src/old name.rs",
    "u UU N... 100644 100644 100644 100644 aaa bbb ccc src/conflict.rs", "? src/untracked file.rs", ""])


def test_status_text(spark):
    df = spark.createDataFrame([(1, STATUS), (2, "# branch.oid (initial)\0# branch.head (detached)\0? new.rs\0")], "k INT, raw STRING")
    rows = {r.path: (r.staged, r.unstaged, r.untracked, r.partially_staged) for r in hunks.parse_status(df, ["k"]).filter("k = 1").collect()}
    assert rows == {
        "src/changed file.rs": (False, True, False, False), "src/new name.rs": (True, False, False, False),
        "src/old name.rs": (False, False, False, False), "src/conflict.rs": (True, True, False, True),
        "src/untracked file.rs": (False, False, True, False)}
    heads = {r.k: (r.head, r.branch) for r in hunks.status_header(df, ["k"]).collect()}
    assert heads == {1: ("abc123", "feature/status"), 2: ("", "")}


def test_diff_stat_of_created_and_deleted_text(spark):
    df = spark.createDataFrame([("p", None, "a\nb\n"), ("q", "a\n", None)], "path STRING, before STRING, after STRING")
    rows = df.select("path", linediff.diff_stat("before", "after").alias("s")).collect()
    assert {r.path: (r.s.added, r.s.removed) for r in rows} == {"p": (2, 0), "q": (0, 1)}


def test_diff_views(spark):
    df = spark.createDataFrame([("p", "ab\ncdef\n")], "path STRING, diff STRING")
    view = lambda detail, cap=0: tuple(edits.shape_diff(df, detail, cap).select("diff", "truncated", "omitted").first())
    assert view("compact") == (None, False, True) and view("debug", 1) == ("ab\ncdef\n", False, False)
    assert view("standard", 5) == ("ab\n", True, False) and view("standard", 99) == ("ab\ncdef\n", False, False)


def test_diagnostics_name_broken_files_only(corpus):
    df = corpus({"a.py": "def f(:\n", "b.py": "x = 1\n", "c.md": "(("})
    assert [(r.path, r.severity) for r in edits.diagnostics(df).collect()] == [("a.py", "error")]


def test_diff_cursor(spark):
    from corposcope import EngineError
    from corposcope.plans import diff_pages

    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([10, 10, 50, 5, 5])], "hunk_no INT, text STRING")
    seen, token = [], None
    while True:
        shown, token = diff_pages.page(df, "snap", max_chars=20, scope={"paths": ["a"]}, continuation=token)
        seen.append([r.hunk_no for r in shown.collect()])
        if token is None:
            break
        last = token
    assert seen == [[0, 1], [2], [3, 4]]
    for options, code in (({"snapshot_id": "other"}, "STALE_CONTINUATION"), ({"scope": {}}, "CONTINUATION_SCOPE_MISMATCH"), ({"continuation": "x"}, "INVALID_CONTINUATION")):
        arguments = {"snapshot_id": "snap", "scope": None, "continuation": last, **options}
        with pytest.raises(EngineError) as error:
            diff_pages.page(df, arguments.pop("snapshot_id"), max_chars=20, **arguments)
        assert error.value.code == code


def test_diff_cursor_over_several_files(spark):
    from corposcope.plans import diff_pages

    df = spark.createDataFrame([(f, i, "@@ -1 +1 @@\n") for f in "abc" for i in range(2)], "file STRING, hunk_no INT, text STRING")
    seen, token = [], None
    while True:
        shown, token = diff_pages.page(df, "snap", max_chars=15, continuation=token)
        seen += [(r.file, r.hunk_no) for r in shown.collect()]
        if token is None:
            break
    assert seen == [(f, i) for f in "abc" for i in range(2)]


def test_transaction_conflicts(spark, corpus):
    files = corpus({"a": "one\r\ntwo\r\n", "b": "b"})
    changes = spark.createDataFrame([
        ("t1", 1, "replace", "a", None, "one\ntwo", "1", 1, False), ("t2", 1, "delete", "b", None, None, None, 0, False), ("t2", 2, "rename", "a", "b", None, None, 0, False),
        ("t3", 1, "create", "a", None, None, "x\ny", 0, True), ("t4", 1, "create", "a", None, None, "x", 0, None)],
        "txn STRING, seq INT, kind STRING, path STRING, to STRING, old_text STRING, new_text STRING, expected INT, overwrite BOOLEAN")
    rows = {(r.txn, r.path): (r.after, r.error) for r in edits.plan_transactions(changes, files).collect()}
    assert rows == {("t1", "a"): ("1\r\n", None), ("t2", "a"): (None, "PATH_EXISTS"), ("t3", "a"): ("x\r\ny", None), ("t4", "a"): (None, "PATH_EXISTS")}


def test_diff_and_stat_agree_on_repeated_lines(spark):
    from corposcope.functions import linediff

    before = "".join(f"{'same' if i % 2 else i % 9}\n" for i in range(300))
    after = "".join(line for i, line in enumerate(before.splitlines(keepends=True)) if not 100 <= i < 114)
    row = spark.createDataFrame([("p", before, after)], "path STRING, b STRING, a STRING").select(
        linediff.unified_diff("path", "b", "a").alias("d"), linediff.diff_stat("b", "a").alias("s")).first()
    lines = row.d.split("\n")[2:]
    assert (row.s.added, row.s.removed) == (sum(x.startswith("+") for x in lines), sum(x.startswith("-") for x in lines))


def _exchanges_with(df, column):
    """Physical nodes that move or sort rows and output ``column``."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.split("\n") if any(n in x for n in ("Exchange ", "Sort ", "TakeOrdered")) and "Broadcast" not in x and f"{column}#" in x]


def test_point_reads_and_top_k_move_no_texts(spark, corpus):
    from corposcope.operators import reads, search

    files = corpus({f"d/f{i}.txt": "needle text\n" * 3 for i in range(50)})
    asked = spark.createDataFrame([("d/f1.txt",), ("gone",)], "path STRING")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (reads.read_paths(files, asked), edits.rename(files, asked.selectExpr("path", "'x' AS to")), search.search_text(files, "needle")):
            df.collect()
            assert "Join" in df._jdf.queryExecution().executedPlan().toString()
            assert _exchanges_with(df, "content") == []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


EDIT_TEXTS = st.lists(st.sampled_from(["a", "b", "\n", "\r\n", "ab"]), max_size=12).map("".join)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(EDIT_TEXTS, st.sampled_from(["a", "ab", "a\n", "\n"]), st.integers(1, 3)), min_size=1, max_size=40))
def test_exact_replacement_equals_a_sequential_model(spark, cases):
    def label(t):
        crlf = t.count("\r\n")
        lf, cr = t.count("\n") - crlf, t.count("\r") - crlf
        return "none" if not (crlf or lf or cr) else "crlf" if not (lf or cr) else "lf" if not (crlf or cr) else "mixed"

    def adapt(t, kind):
        plain = t.replace("\r\n", "\n").replace("\r", "\n")
        return plain.replace("\n", "\r\n") if kind == "crlf" else plain if kind == "lf" else t

    def model(content, old, expected):
        needle, new = adapt(old, label(content)), adapt("X\nY", label(content))
        if needle == old or content.count(needle) != expected:
            needle = old
        if content.count(needle) != expected:
            return None
        if needle.endswith("\n"):
            new += "\r\n" if needle.endswith("\r\n") else "\n"
        return content.replace(needle, new, expected)

    rows = [(f"p{i}", c, o, e) for i, (c, o, e) in enumerate(cases)]
    df = spark.createDataFrame(rows, "path STRING, content STRING, old STRING, expected INT")
    plan = edits.replace_exact(df, F.col("old"), F.lit("X\nY"), F.col("expected"))
    assert {r.path: r.after for r in plan.collect()} == {p: model(c, o, e) for p, c, o, e in rows}
