"""Joins and sums over ranges of the data, interval folds and the multi-pattern scan, against plain versions."""

import random
import time
from datetime import datetime, timedelta

import pytest

from corposcope.functions import intervals, multipattern
from corposcope.operators import changelog, reads, search


def plain_owner(spans, i):
    a, b, _ = spans[i]
    around = [(y - x, n) for x, y, n in spans if x <= a and y >= b and (x < a or y > b)]
    return min(around)[1] if around else None


@pytest.mark.parametrize("nested", [True, False])
def test_smallest_interval_around(nested):
    rng = random.Random(nested)

    def inside(a, b, depth):
        out = [(a, b, f"n{rng.randrange(99)}")]
        while depth and b - a > 1 and rng.random() < 0.8:
            x = rng.randint(a, b)
            out += inside(x, rng.randint(x, b), depth - 1)
        return out

    for _ in range(60):
        if nested:
            cuts = sorted(rng.sample(range(400), 8))
            spans = [s for a, b in zip(cuts[::2], cuts[1::2]) for s in inside(a, b, 3)]
        else:
            spans = [(x, x + rng.randint(0, 9), f"n{rng.randrange(9)}") for x in (rng.randint(0, 20) for _ in range(25))]
        rng.shuffle(spans)
        assert intervals.smallest_around(spans) == [plain_owner(spans, i) for i in range(len(spans))]


def test_many_intervals_are_linear():
    spans = [(0, 10**6, "file")] + [(10 * i, 10 * i + 9 - i % 5, f"f{i}") for i in range(20_000)] + [(300_000 + i, 900_000 - i, "deep") for i in range(20_000)]
    began = time.perf_counter()
    assert len(intervals.smallest_around(spans)) == len(spans)
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize("case_sensitive", [True, False])
def test_all_literals_in_one_pass(case_sensitive):
    rng = random.Random(7)
    patterns = ("ab", "b", "AB", "é", "É", "a\r", "a\nb", "", "abab", "b", "\r")
    fold = (lambda t: t) if case_sensitive else (lambda t: "".join(c.lower() if c < "\x80" else c for c in t))
    for _ in range(200):
        content = "".join(rng.choice(["a", "b", "A", "é", "É", "\n", "\r\n", "\r"]) for _ in range(rng.randint(0, 30)))
        lines = content.replace("\r\n", "\n").split("\n")
        want = [[n + 1 for n, line in enumerate(lines) if p and "\n" not in p and fold(p) in fold(line)] for p in patterns]
        assert [x.tolist() for x in multipattern.lines_with(content, patterns, case_sensitive)] == want


def test_a_bad_query_is_its_own_error(corpus):
    df = corpus({"a.txt": "one\ntwo\n", "b.txt": "two\n", "c.txt": ""})
    rows = search.search_many(df, ["two", "", "one"], context=0).orderBy("query_index", "rank").collect()
    assert [(r.query, r.path, r.preview, r.error) for r in rows] == [("two", "a.txt", "two", None), ("two", "b.txt", "two", None), ("", None, None, "INVALID_REQUEST"), ("one", "a.txt", "one", None)]
    rows = search.search_many(df, ["t.o", "(", "(?=x)"], syntax="regex", context=0).collect()
    assert sorted((r.query_index, r.error or r.path) for r in rows) == [(0, "a.txt"), (0, "b.txt"), (1, "INVALID_REGEX"), (2, "INVALID_REGEX")]
    assert [r.error for r in search.search_many(df, [""]).collect()] == ["INVALID_REQUEST"]


def test_runs_over_many_generations_and_a_hot_one(spark):
    """A run may span any number of generations; one generation has most of the log."""
    rng = random.Random(3)
    t0 = datetime(2024, 1, 1)
    log = [(f"p{rng.randrange(20)}", rng.choice([5, 5, 5, rng.randrange(100), 10**12 - rng.randrange(50)]), t0 + timedelta(minutes=rng.randrange(1000))) for _ in range(3000)]
    runs = [("all", -1, 10**13, None), ("hot", 4, 5, t0 + timedelta(minutes=500)), ("none", 7, 7, None), ("late", 10**12 - 25, 10**12, None), ("early", 0, 60, t0 + timedelta(minutes=3))]
    got = changelog.attribute_runs(
        spark.createDataFrame(log, "path STRING, generation BIGINT, timestamp TIMESTAMP"),
        spark.createDataFrame(runs, "run_id STRING, start_generation BIGINT, end_generation BIGINT, ended_at TIMESTAMP"),
    )
    want = {}
    for run, a, b, end in runs:
        for path, g, ts in log:
            if a < g <= b and (end is None or ts <= end):
                want[run, path] = want.get((run, path), 0) + 1
    assert {(r.run_id, r.path): r.changes for r in got.collect()} == want


def test_one_request_over_many_ranges(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["a", "b", None]), i, f"p{i}", "x" * rng.choice([0, 1, 30])) for i in range(1500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "request STRING, seq INT, path STRING, content STRING").repartition(5)
        got = {(r.request, r.seq): (r.total, r.granted) for r in reads.share_budget(df, 9000).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    used, want = {}, {}
    for request, seq, _, content in rows:
        granted = min(len(content), max(9000 - used.get(request, 0), 0))
        used[request] = used.get(request, 0) + len(content)
        if granted or not content:
            want[request, seq] = (len(content), granted)
    assert got == want and used["hot"] > 9000
