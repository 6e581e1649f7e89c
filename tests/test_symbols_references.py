import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from corposcope import EngineError
from corposcope.operators import references, symbols


def files(corpus, items):
    return symbols.with_symbols(corpus(items), "code")


def find(df, name, path=None, line=None, **options):
    target = references.resolve_symbol(df, name, path, line, parsed=True)
    return references.find_references(df, target, parsed=True, **options).collect()


def test_declarations_of_each_language(corpus):
    df = files(corpus, {
        "a.py": "class Box:\n    def open(self):\n        return 1\n\nasync def run():\n    pass\n",
        "b.rs": "pub fn hello() {}\npub struct Point {\n    x: i32,\n}\n",
        "c.ts": "export class View {\n  render(): void {\n  }\n}\nfunction go() { return 1; }\n",
        "d.txt": "class Nothing\n",
    })
    found = {(r.path, r.name, r.kind, r.start_line, r.end_line) for r in symbols.symbol_rows(df).collect()}
    assert found == {
        ("a.py", "Box", "class_definition", 1, 3), ("a.py", "open", "function_definition", 2, 3),
        ("a.py", "run", "function_definition", 5, 6), ("b.rs", "hello", "function_item", 1, 1),
        ("b.rs", "Point", "struct_item", 2, 4), ("c.ts", "View", "class_declaration", 1, 4),
        ("c.ts", "render", "method_definition", 2, 3), ("c.ts", "go", "function_declaration", 5, 5),
    }


def test_ranked_symbol_search(corpus):
    df = files(corpus, {"src/settings.rs": "pub struct CrawlRunSettings;\n", "src/model.rs": "pub struct CrawlRun;\n"})
    found = symbols.find_symbol(df, "crawlrun").collect()
    assert [(r.name, r.match_type, r.score) for r in found] == [
        ("CrawlRun", "exact_symbol", 1.0), ("CrawlRunSettings", "prefix_symbol", 0.8)]


def test_the_declaration_is_left_out(corpus):
    df = files(corpus, {"src/workspace.rs": "pub fn open_workspace() {}\n", "src/main.rs": "fn main() { open_workspace(); }\n"})
    assert [r.path for r in find(df, "open_workspace", context=1)] == ["src/main.rs"]


def test_single_letter_symbol(corpus):
    df = files(corpus, {"src/owner.rs": "pub fn x() {}\n", "src/caller.rs": "fn call() { x(); }\n"})
    assert [r.path for r in find(df, "x", context=0)] == ["src/caller.rs"]


def test_identifier_boundaries(corpus):
    df = files(corpus, {"x.txt": "run run_more prerun $run run();\n"})
    assert [r.column for r in references.occurrence_rows(df, "run").collect()] == [1, 26]


def test_adjacent_and_overlapping_raw_matches(corpus):
    df = files(corpus, {"x.txt": "xa-a-a a-a a-aa-a aé-a"})
    # The first raw match takes the characters a later boundary match would need.
    assert [(r.column, r.start_byte) for r in references.occurrence_rows(df, "a-a").collect()] == [(8, 7)]


def test_results_are_spread_over_files(corpus):
    df = files(corpus, {
        "src/owner.rs": "pub fn process_run() {}\n", "tests/noisy.rs": "process_run();\n" * 12, "src/caller.rs": "fn call() { process_run(); }\n"})
    found = find(df, "process_run", context=0, max_results=8)
    assert sum(r.path == "tests/noisy.rs" for r in found) <= 3
    assert any(r.path == "src/caller.rs" for r in found)
    target = references.resolve_symbol(df, "process_run")
    assert references.reference_summary(df, target, context=0, max_results=8).first().truncated


def test_neighbouring_matches_share_a_window_of_three(corpus):
    df = files(corpus, {"src/owner.rs": "pub fn process_run() {}\n",
                        "src/caller.rs": "fn call() {\n    process_run();\n    process_run();\n    process_run();\n}\n"})
    found = [r for r in find(df, "process_run", context=1) if r.path == "src/caller.rs"]
    assert [(r.start_line, r.end_line, r.occurrences) for r in found] == [(1, 5, 3)]


def test_python_roles_and_order(corpus):
    df = files(corpus, {
        "owner.py": "def extract():\n    pass\n", "a_import.py": "from owner import extract\n",
        "m_write.py": "extract = 1\n", "z_call.py": "def run():\n    extract()\n", "n_type.py": "def f(a) -> extract:\n    pass\n"})
    found = find(df, "extract", context=0)
    assert [(r.path, r.reference_kind, r.score) for r in found] == [
        ("z_call.py", "call", 1.0), ("m_write.py", "write", 0.9), ("n_type.py", "type", 0.85), ("a_import.py", "import", 0.75)]
    assert found[0].enclosing_symbol == "run" and found[0].classification_evidence == "syntactic"
    only = find(df, "extract", context=0, kinds=["import", "declaration"])
    assert [(r.path, r.match_type) for r in only] == [("owner.py", "declaration"), ("a_import.py", "reference")]


def test_ambiguous_and_unknown_symbols(corpus):
    df = files(corpus, {"a.py": "def same():\n    pass\n", "b.py": "def same():\n    pass\n"})
    with pytest.raises(EngineError) as error:
        references.resolve_symbol(df, "same")
    assert error.value.code == "AMBIGUOUS_SYMBOL" and len(error.value.details["candidates"]) == 2
    assert references.resolve_symbol(df, "same", "b.py").path == "b.py"
    with pytest.raises(EngineError) as error:
        references.resolve_symbol(df, "absent")
    assert error.value.code == "SYMBOL_NOT_FOUND"


def test_qualified_names(corpus):
    df = files(corpus, {"a.py": "class One:\n    def run(self):\n        pass\n\nclass Two:\n    def run(self):\n        pass\n"})
    assert references.resolve_symbol(df, "Two.run").start_line == 6
    assert references.resolve_symbol(df, "One::run").start_line == 2


def test_positions_prefer_the_symbol_that_starts_there(corpus):
    from pyspark.sql import functions as F

    df = files(corpus, {"a.py": "class One:\n    def run(self):\n        pass\n"})
    assert symbols.resolve_positions(df, F.lit(3)).first().name == "run"
    assert symbols.resolve_positions(df, F.lit(1)).first().name == "One"
    assert symbols.definition_at(df, F.lit(3)).first().name == "One"
    assert symbols.resolve_positions(df, F.lit(9)).first().error == "SYMBOL_NOT_FOUND"


def test_identifier_table_agrees_with_the_direct_scan(corpus):
    items = {"a.txt": "eins zwei éa éa_b\nzwei $x zwei\n", "b.txt": "zwei"}
    df = files(corpus, items)
    table = {(r.path, r.line, r.column) for r in references.identifiers(df).filter("token = 'zwei'").collect()}
    direct = {(r.path, r.line, r.column) for r in references.occurrence_rows(df, "zwei").collect()}
    assert table == direct == {("a.txt", 1, 6), ("a.txt", 2, 1), ("a.txt", 2, 9), ("b.txt", 1, 1)}


def test_scope_of_references(corpus):
    df = files(corpus, {"src/o.py": "def f():\n    pass\n", "tests/t.py": "f()\n", "docs/d.py": "f()\n", "src/u.py": "f()\n"})
    by = lambda scope: [r.path for r in find(df, "f", context=0, reference_scope=scope)]
    assert by("tests") == ["tests/t.py"] and by("production") == ["src/u.py"]
    assert by("all") == ["docs/d.py", "src/u.py", "tests/t.py"]


def sequential_windows(content, name, context):
    lines = content.split("\n")
    count = max(1, len(lines) - (1 if lines[-1] == "" else 0))
    out = []
    for number, line in enumerate(lines, 1):
        for word in line.split(" "):
            if word != name:
                continue
            start, end = max(number - context, 1), min(number + context, count)
            if out and start <= out[-1][2] + 1 and out[-1][3] < 3:
                out[-1][2], out[-1][3] = max(out[-1][2], end), out[-1][3] + 1
            else:
                out.append([number, start, end, 1])
    return [tuple(w) for w in out]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["f", "ff", " ", "\n", "\n\n\n", " f "]), max_size=30).map("".join), min_size=1, max_size=20), st.integers(0, 2))
def test_reference_windows_equal_a_sequential_model(spark, texts, context):
    df = symbols.with_symbols(spark.createDataFrame([(f"p{i}.txt", t) for i, t in enumerate(texts)], "path STRING, content STRING"), "code")
    target = references.Target("f", "heading", "elsewhere", 1, 1)
    rows = references.reference_windows(df, target, context=context).collect()
    got = {r.path: [(w.line, w.start_line, w.end_line, len(w.occurrences)) for w in r.windows] for r in rows}
    expected = {f"p{i}.txt": sequential_windows(t, "f", context) for i, t in enumerate(texts)}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in expected.items() if v}
