import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corposcope import EngineError
from corposcope.functions import text
from corposcope.operators import index, search


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_overlapping_hits_merge_and_files_take_turns(corpus):
    df = corpus({"src/alpha.rs": "needle one\nneedle two\nneedle three\n", "src/beta.rs": "prefix\nneedle beta\nsuffix\n"})
    found = rows(search.search_text(df, "needle", context=1), "path", "line", "start_line", "end_line")
    assert found == [("src/alpha.rs", 1, 1, 3), ("src/beta.rs", 2, 1, 3)]


@pytest.mark.parametrize("query", ["x", "to"])
def test_short_and_stop_word_needles_scan_everything(corpus, query):
    df = corpus({"src/value.rs": "let x = to();\n"})
    assert rows(search.search_text(df, query, context=0, case_sensitive=True), "path") == [("src/value.rs",)]


def test_term_miss_has_no_fallback(corpus):
    df = corpus({"a.txt": "hello\n"})
    assert search.search_text(df, "ello").count() == 0
    assert search.search_text(df, "ello", prune="none").count() == 1


def test_regex_case(corpus):
    df = corpus({"src/value.rs": "Alpha\nmiddle\nalpha\n"})
    options = dict(syntax="regex", context=0)
    assert rows(search.search_text(df, "^alpha$", **options), "line") == [(1,), (3,)]
    assert rows(search.search_text(df, "^alpha$", case_sensitive=True, **options), "line") == [(3,)]


def test_posix_classes_and_named_groups(corpus):
    df = corpus({"a": "zzz\n\n:::\n\n12\n\nÄ\n"})
    options = dict(syntax="regex", context=0, case_sensitive=True)
    for pattern, lines in (("^[[:alpha:]]+$", [1]), ("^[[:punct:]]+$", [3]), ("^[^[:alpha:]]+$", [3, 5, 7]), ("^[[:^digit:]]+$", [1, 3, 7]), ("^(?<n_1>z)+(?P<m>z)$", [1])):
        assert [r[0] for r in rows(search.search_text(df, pattern, **options), "line")] == lines


@pytest.mark.parametrize("pattern", ["(a+)+$", "[[:what:]]", "(?=a)", r"(a)\1", "a++", "(", "a{2}+"])
def test_unsupported_regex_is_refused(pattern):
    with pytest.raises(EngineError) as error:
        search.check_regex(pattern)
    assert error.value.code == "INVALID_REGEX"


AMBIGUOUS = [r"([a-z]+\s?)*$", "(a|a)*b", r"(\w+\d?)+x", "(a*)*", "(a|ab|b)*", "(x{1,3})*y", "(.*a)*", r"(\p{L}+\s*)+", "((a|b)+c?)*"]
CLEAR = [
    "(ab+)+", "a+b+", ".*foo.*bar", r"(\w+\s)+x", r"\bfoo(bar|baz)*\b", r"(\p{L}+\s)+", "(a|b)*", "(ab|a)*c", r"^\s*(def|class)\s+\w+", "([0-9]+,)*[0-9]+",
    r"[[:alpha:]]+\d", r"\x{41}+", "a{500}b{1,300}", r"\w+\s?\z", "(?P<n>a+)b",
]


@pytest.mark.parametrize("pattern", AMBIGUOUS)
def test_two_ways_round_a_loop_are_refused(pattern):
    with pytest.raises(EngineError) as error:
        search.check_regex(pattern)
    assert error.value.code == "INVALID_REGEX"


@pytest.mark.parametrize("pattern", CLEAR)
def test_one_way_round_a_loop_is_accepted(pattern):
    assert search.check_regex(pattern) == pattern


def test_one_scope_lifts_the_per_file_cap(corpus):
    df = corpus({"a/x.txt": "needle\n\n\n" * 12, "b.txt": "needle\n"})
    assert search.search_text(df, "needle", context=0, max_results=50).count() == 9
    assert search.search_text(df, "needle", scope=["a"], context=0, max_results=50).count() == 12
    stats = search.search_stats(df, "needle", context=0, max_results=50).first()
    assert (stats.total_windows, stats.result_count, stats.truncated) == (13, 9, True)


def test_crlf_preview_is_lf_and_blank_head_lines_go(corpus):
    df = corpus({"a.txt": "\r\nneedle\r\nend\r\n"})
    assert rows(search.search_text(df, "needle", context=1), "start_line", "end_line", "preview") == [(1, 3, "needle\nend")]


def test_ascii_folding_only(corpus):
    df = corpus({"a.txt": "ÄRGER\närger\nABC\n"})
    assert search.search_text(df, "är", context=0, prune="none").first()["line"] == 2
    assert search.search_text(df, "abc", context=0).first()["line"] == 3


def test_filename_glob_and_substring(corpus):
    df = corpus({"backend/app/core/records/output_safety.py": "", "backend/app/core/other.py": ""})
    assert rows(index.find_file(df, "*output*safety*"), "path", "match_type") == [("backend/app/core/records/output_safety.py", "glob")]
    assert rows(index.find_file(df, "OTHER"), "path") == [("backend/app/core/other.py",)]
    assert index.find_file(df, "OTHER", case_sensitive=True).count() == 0


def test_repo_map_scope_is_strict(corpus):
    df = corpus({"backend/app/main.py": "", "backend/tests/test_main.py": "", "README.md": ""})
    assert rows(index.repo_map(df, scope=["backend/app"]), "directory", "files", "languages") == [("backend/app", 1, "python")]
    assert rows(index.repo_map(df), "directory") == [(".",), ("backend/app",), ("backend/tests",)]
    counts = index.scope_counts(df, ["backend/app"]).first()
    assert (counts.file_count, counts.total_file_count, counts.scope_applied) == (1, 3, True)


def test_several_queries_in_one_scan(corpus):
    df = corpus({"a.txt": "one\ntwo\n", "b.txt": "two\n"})
    found = search.search_many(df, ["two", "one"], context=0).orderBy("query", "rank")
    assert rows(found, "query", "path", "line") == [("one", "a.txt", 1), ("two", "a.txt", 2), ("two", "b.txt", 1)]


def reference_lines(content):
    pieces = content.split("\n")
    lines = [p[:-1] if p.endswith("\r") and i < len(pieces) - 1 else p for i, p in enumerate(pieces)]
    return lines[:-1] if lines[-1] == "" else lines


def reference_windows(content, needle, context):
    lines, out = reference_lines(content), []
    for number, line in enumerate(lines, 1):
        if needle in line:
            start, end = max(number - context, 1), min(number + context, max(len(lines), 1))
            if out and start <= out[-1][2] + 1:
                out[-1][2] = max(out[-1][2], end)
            else:
                out.append([number, start, end])
    return [tuple(w) for w in out]


WORDS = st.lists(st.sampled_from(["ab", "a", "9", "_", ".", "-", " ", "é", "AB", "b"]), max_size=14).map("".join)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(WORDS, min_size=1, max_size=60), st.sampled_from(["ab", "ab_a", "a-b", "b9", "aab", "ab.ab"]))
def test_term_test_equals_the_term_list(spark, texts, term):
    df = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "path STRING, content STRING")
    listed = index.with_terms(df.withColumn("symbols", F.expr("cast(array() as array<struct<name: string>>)")))
    got = {r.path for r in df.filter(search.has_term(df, [term])).collect()}
    assert got == {r.path for r in listed.filter(search.has_term(listed, [term])).collect()}


TEXTS = st.lists(st.sampled_from(["a", "b", "n", "\n", "\r\n", "\r", "\n\n\n"]), max_size=40).map("".join)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(TEXTS, min_size=1, max_size=30), st.integers(0, 3))
def test_windows_equal_a_sequential_model(spark, texts, context):
    df = spark.createDataFrame([(f"p{i:03d}", t) for i, t in enumerate(texts)], "path STRING, content STRING")
    windows = search.match_windows(df, search.line_matcher("n", "literal", True), context)
    got = {r.path: [(w.line, w.start_line, w.end_line) for w in r._windows] for r in windows.select("path", "_windows").collect()}
    assert got == {f"p{i:03d}": reference_windows(t, "n", context) for i, t in enumerate(texts)}


@pytest.mark.parametrize(
    "content", ["a\nb\n", "a\r\nb", "", "a\r\r\nb\r", "\n", "x\n\ny\n", "\r", "\r\n"]
)
def test_line_rule(corpus, content):
    row = text.with_lines(corpus({"p": content})).select("lines", text.line_count("content").alias("n")).first()
    assert row.lines == reference_lines(content)
    assert row.n == max(1, len(reference_lines(content)))


def test_many_patterns_scan_a_text_once(spark, corpus):
    df = corpus([("a.txt", "one\r\ntwo one\n"), ("b.txt", None), ("c.txt", ""), ("d.txt", "TWO\n")])
    found = search.search_many(df, ["two", "one", "absent"], context=0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert sorted((r.query, r.path, r.line, r.start_line, r.end_line) for r in found.collect()) == [("one", "a.txt", 1, 1, 2), ("two", "a.txt", 2, 2, 2), ("two", "d.txt", 1, 1, 1)]
