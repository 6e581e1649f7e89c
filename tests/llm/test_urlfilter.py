import random

import numpy as np
import pytest

from corposcope.llm import queries, urlfilter
from corposcope.llm.urlfilter import Rule


def test_parts():
    cases = {
        None: ("", ""), "": ("", ""), "example.org/x": ("", ""), "://": ("", ""), "http://A.Example.ORG": ("a.example.org", ""),
        "http://a.org?q=/x": ("a.org", ""), "http://a.org#f/x": ("a.org", ""), "http://a.org/Bc/#f?q": ("a.org", "/Bc/"), "x://É.org:80/?": ("É.org:80", "/"),
        "http://a.org/r?u=http://b.org/": ("a.org", "/r"), "q?http://b.org/c#": ("b.org", "/c"),
    }
    assert {u: urlfilter.parts_of(u) for u in cases} == cases


def matches(pattern, text):
    """The set of places in the pattern after each symbol; a star may be left at any time."""
    reach = {0}
    for c in [*text, None]:
        for i in range(len(pattern)):
            if i in reach and pattern[i] == "*":
                reach.add(i + 1)
        if c is None:
            return len(pattern) in reach
        symbol = urlfilter.SEPARATOR if c == "|" else ord(c)
        stay = {i for i in reach if i < len(pattern) and pattern[i] == "*" and c != "|"}
        reach = stay | {i + 1 for i in reach if i < len(pattern) and (pattern[i] == symbol or (pattern[i] == "?" and c != "|"))}
    return None


@pytest.mark.parametrize("seed", range(5))
def test_automaton_against_a_plain_one(seed):
    """Patterns run over several words of 64 bits, and over their ends."""
    rng = random.Random(seed)
    patterns = [[rng.choice(["*", "?", 97, 98, urlfilter.SEPARATOR]) for _ in range(rng.randint(0, 70 if seed else 9))] for _ in range(40)]
    patterns += [[*"*", 97, "*", urlfilter.SEPARATOR, "*"], []]
    texts = ["".join(rng.choice("ab|") for _ in range(rng.randint(0, 60))) for _ in range(80)] + ["", "|", "a" * 300]
    texts += ["".join({"*": "ab", "?": "b", urlfilter.SEPARATOR: "|"}.get(s) or chr(s) for s in p) for p in patterns]
    coded = [np.array([urlfilter.SEPARATOR if c == "|" else ord(c) for c in t], np.int64) for t in texts]
    got = urlfilter.Automaton(patterns).run(coded)
    assert got.tolist() == [[matches(p, t) for p in patterns] for t in texts] and got.any()


def test_longest_rule_wins():
    rules = urlfilter.Filter([Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "a.example.org", "/es"), Rule("allow", "a.example.org", "/"), Rule("block", "xample.org", "/")], (("*bad*", "*"),))
    cases = {
        "http://org/": ("org/", "allow"), "http://x.org/bad": ("org/", "allow"), "http://x.org": (None, "allow"), "http://bad.net": (None, "block"),
        "http://example.org/es/": ("example.org/es/", "block"), "http://a.example.org/es/": ("a.example.org/es", "block"), "http://b.a.example.org/e": ("a.example.org/", "allow"),
        "http://notexample.org/es/": ("org/", "allow"), "http://x.net/.example.org/es/": (None, "allow"), "http://x.net/bad": (None, "allow"),
    }
    names, verdicts, _ = rules.judge([urlfilter.parts_of(u) for u in cases])
    assert dict(zip(cases, zip(names, verdicts, strict=True), strict=True)) == cases
    with pytest.raises(ValueError):
        urlfilter.Filter([Rule("deny", "x", "/")])


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "http://x.org/" + "a" * 100_000), (3, "http://x.org/"), (None, "http://free-bets.example.com/en/5"), (4, "http://m.x.com/de/1?x"), (5, "no url"), (6, "http://例え.com/fr/")]
    df = spark.createDataFrame([(i, u, "h", "k", 1) for i, u in rows], "page_id BIGINT, url STRING, html STRING, host STRING, key INT")
    got = [(r["page_id"], r["host"], len(r["path"]), r["rule"], r["verdict"]) for r in urlfilter.judge(df, queries.URL_RULES).collect()]
    assert sorted(got, key=str) == sorted(
        [
            (1, "", 0, None, "allow"), (2, "", 0, None, "allow"), (3, "x.org", 100_001, "org/", "allow"), (3, "x.org", 1, "org/", "allow"), (None, "free-bets.example.com", 5, None, "block"),
            (4, "m.x.com", 5, "com/de/", "block"), (5, "", 0, None, "allow"), (6, "例え.com", 4, "com/fr/", "allow"),
        ], key=str,
    )
    assert urlfilter.judge(df.limit(0), queries.URL_RULES).collect() == []


def test_rules_beyond_the_bound_are_refused():
    with pytest.raises(ValueError):
        urlfilter.Automaton([[97] * 1_100_000])
