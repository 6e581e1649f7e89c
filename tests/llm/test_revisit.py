import random

from pyspark.sql import functions as F

from corposcope.llm import revisit

SCHEMA = "record_id BIGINT, url STRING, ts BIGINT, kind STRING, status INT, headers MAP<STRING,STRING>, prior STRING, late INT"


def resolved(spark, rows):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA)
    return {r["record_id"]: (r["outcome"], r["response_id"], r["merged"]) for r in revisit.resolve(df).collect()}


def test_outcomes_and_merging(spark):
    ok = {"ETag": '"a"', "Content-Length": "9", "Content-Type": "text/html", "Age": "1", "Last-Modified": "mon"}
    rows = [
        (1, "http://www.A.example/x/?utm_source=q&b=2&a=1#f", 10, "response", 200, ok),
        (2, "https://a.example:443/x?a=1&b=2", 20, "revisit", 304, {"etag": 'W/"a"', "age": "5", "content-length": "0", "connection": "Close, X-Hop", "x-hop": "1", "close": "1"}),
        (3, "http://a.example/x?a=1&b=2", 20, "revisit", 304, {"etag": '"b"'}),
        (4, "http://a.example/x?a=1&b=2", 10, "revisit", 304, {"etag": '"a"'}),
        (5, "http://a.example/x?a=1&b=2", 25, "revisit", 304, {"Last-Modified": "mon"}),
        (6, "http://a.example/x?a=1&b=2", 25, "revisit", 304, {"Last-Modified": "tue"}),
        (7, "http://a.example/x?a=1&b=2", 25, "revisit", 304, None),
        (8, "http://a.example/x?a=1&b=2", 26, "response", 404, {"etag": '"c"'}),
        (9, "http://a.example/x?a=1&b=2", 27, "revisit", 304, {"etag": '"c"'}),
        (10, "http://b.example", 1, "response", 200, None),
        (11, "http://b.example/", 2, "revisit", 304, {"etag": '"z"'}),
        (12, None, 5, "revisit", 304, {}),
        (13, "http://b.example/", None, "revisit", 304, {}),
        (14, "http://b.example/", 9, "metadata", 0, {}),
        (None, "http://b.example/", 9, "revisit", 304, {}),
        (15, "http://b.example", 3, "response", 200, {}),
        (16, "http://b.example", 3, "response", 200, {"n": "1", "N": "2"}),
        (17, "http://b.example", 4, "revisit", 304, {"e": None}),
    ]
    got = resolved(spark, rows)
    assert {k: v[0] for k, v in got.items()} == {
        2: "resolved", 3: "mismatch", 4: "no_response", 5: "resolved", 6: "mismatch", 7: "resolved", 9: "mismatch",
        11: "not_comparable", 12: "no_response", 13: "no_response", 17: "resolved",
    }
    assert got[2][1:] == (1, {"etag": 'W/"a"', "age": "5", "content-length": "9", "content-type": "text/html", "last-modified": "mon"})
    assert got[17][1:] == (16, {"n": "2", "e": None})
    assert resolved(spark, []) == {}


def test_one_url_over_many_ranges(spark):
    """As-of join against a loop, where one URL has most records and spans the ranges."""
    rng = random.Random(8)
    rows = [
        (i, "http://hot.example/" if rng.random() < 0.8 else f"http://h{rng.randrange(9)}.example/", rng.randrange(400), rng.choice(["response", "revisit", "revisit"]), 200, {})
        for i in range(1500)
    ]
    latest = {}
    for i, url, ts, kind, _, _ in rows:
        if kind == "revisit":
            earlier = [(t, j) for j, u, t, k, _, _ in rows if k == "response" and u == url and t < ts]
            latest[i] = max(earlier)[1] if earlier else None
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = resolved(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {k: v[1] for k, v in got.items()} == latest


def test_canonical(spark):
    urls = ["HTTP://WWW2.X.org:80/A/B//?", "x.org/a/b?sid=1&z=2&utm_medium=m&y", " https://x.org/a/b/?y&z=2 "]
    rows = spark.createDataFrame([(u,) for u in urls], "u STRING").select(revisit.canonical(F.col("u")).alias("c")).collect()
    assert [r["c"] for r in rows] == ["x.org/a/b", "x.org/a/b?y&z=2", "x.org/a/b?y&z=2"]
