"""Benchmark: headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line.  Every query runs to the end and all of its rows are
produced (``noop`` sink).  One untimed pass of a small query starts the JVM;
each headline query is then timed ``BENCH_RUNS`` times and the best is kept.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from corposcope.catalog import REGISTRY
from corposcope.operators import index, references
from corposcope.operators.lookup import Stored
from corposcope.session import local_session

HEADLINE = [
    "search_literal_ci", "search_literal_cs", "search_literal_scoped", "search_substring_unpruned", "search_stopword_fullscan",
    "search_regex_ci", "search_regex_cs", "search_multi_query", "search_truncation_stats",
    "find_file_glob", "repo_map", "classify_documents", "content_hash", "snapshot_id", "indexed_terms", "postings", "index_metrics",
    "symbol_table", "find_symbol_ranked", "resolve_position", "enclosing_symbol", "references_lexical", "references_scope_production",
    "references_totals", "identifiers", "reference_counts", "read_range", "read_pages", "read_continuation",
    "hunks_parse", "hunks_page", "porcelain_status", "edit_exact_count", "edit_plan_rename", "edit_overlap", "rename_preview",
    "edit_transactions", "changes_since", "changed_path_groups", "dirty_symmetric_difference", "run_attribution", "refresh_upsert_delete",
    "median_latency", "tail_retention",
]


def gate(spark, warm: int = 3, runs: int = 20) -> float:
    """p95 in ms of a reference query over 300 files of 1000 lines, index stored
    beforehand, symbol resolved by its path, one caller."""
    rows = spark.range(300).selectExpr(
        "format_string('src/file_%03d.rs', id) AS path",
        "concat(CASE id WHEN 0 THEN 'pub fn scale_target() {}' WHEN 299 THEN 'fn consume() { scale_target(); }' ELSE '// scale' END, '\\n', "
        "array_join(transform(sequence(1, 999), i -> format_string('// filler %03d %04d\\n', id, i)), '')) AS content",
    )
    tables = index.build(rows, tempfile.mkdtemp(prefix="corposcope-gate-"), extractor="code")
    stored = Stored.open(spark, tables)
    stored = Stored(*(t.persist() for t in (stored.files, stored.postings, stored.symbols, stored.identifiers)))
    for table in (stored.files, stored.postings, stored.symbols, stored.identifiers):
        table.count()
    timings = []
    for number in range(warm + runs):
        start = time.perf_counter()
        target = references.resolve_symbol(stored.declaring("scale_target", "src/file_000.rs"), "scale_target", "src/file_000.rs")
        found = references.find_references(stored.with_token("scale_target"), target).collect()
        assert [r["path"] for r in found] == ["src/file_299.rs"]
        if number >= warm:
            timings.append((time.perf_counter() - start) * 1000)
    timings.sort()
    return round(timings[round((len(timings) - 1) * 0.95)], 1)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = [a for a in sys.argv[1:] if not a.startswith("--")] or HEADLINE
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    if "--gate" in sys.argv:
        print(json.dumps({"metric": "reference_query_p95", "value": gate(spark), "unit": "ms"}))
        return
    REGISTRY["find_file_stats"].build(spark, sf_dir).collect()
    timings = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            REGISTRY[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            best = spent if best is None else min(best, spent)
        timings[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
