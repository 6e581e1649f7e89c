import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from corposcope.llm import turntrie

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, key STRING, least INT"


def turns(spark, rows):
    return turntrie.sequences(spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA))


def rows_of(conversations):
    return [(c, i, "u", t) for c, texts in conversations.items() for i, t in enumerate(texts)]


def by_hand(conversations):
    """Nodes of {conv: [texts]}."""
    members, ends, kids = defaultdict(set), defaultdict(list), Counter()
    for c, v in sorted(conversations.items()):
        for d in range(len(v) + 1):
            members[tuple(v[:d])].add(c)
        ends[tuple(v)].append(c)
    kids.update(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1]) if k else 0
    return {
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest())
        for k, m in members.items()
    }


def nodes(df):
    found = [tuple(r) for r in turntrie.trie(df).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_find_close():
    rng = random.Random(2)
    for n in (1, 3, 40, 900, 5000):
        opens, depth, left = [], 0, n
        while left or depth:
            if left and (not depth or rng.random() < 0.5):
                opens.append(True)
                depth, left = depth + 1, left - 1
            else:
                opens.append(False)
                depth -= 1
        opens = np.array([True, *opens, False])
        stack, want = [], {}
        for i, o in enumerate(opens):
            if o:
                stack.append(i)
            else:
                want[stack.pop()] = i
        at = np.flatnonzero(opens)
        assert turntrie.Parentheses(opens).find_close(at).tolist() == [want[i] for i in at.tolist()]


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(turntrie, "LEAST_SEQUENCES", 6)
    monkeypatch.setattr(turntrie, "LAST_SEQUENCES", 9)
    monkeypatch.setattr(turntrie, "SHARD_TURNS", 8)


@pytest.mark.parametrize("seed", range(2))
def test_spines_of_many_shards_meet(spark, small_shards, seed):
    """Several rounds; prefixes of other conversations, equal ones, one deep one, ends on spines."""
    rng = random.Random(seed)
    conversations = {c: [rng.choice(["a", "bb", "ccc"]) for _ in range(rng.randint(1, 5))] for c in range(140)}
    conversations |= {200 + c: ["a", "bb"] for c in range(40)} | {300: ["a"] * 60, 301: ["a"] * 59}
    assert nodes(turns(spark, rows_of(conversations))) == by_hand(conversations)


def test_many_members_of_one_end(spark, monkeypatch):
    monkeypatch.setattr(turntrie, "IDS", 7)
    conversations = {c: ["same", "same"] for c in range(95, 205)} | {1: ["same"], 2: ["other"]}
    assert nodes(turns(spark, rows_of(conversations))) == by_hand(conversations)


def test_order_and_nulls(spark):
    rows = [(1, 2, "u", "b"), (1, None, None, None), (1, 1, "u", "a"), (2, None, "", ""), (2, 0, "u", "a"), (2, 7, "u", "b"), (None, 0, "u", "a"), (3, 0, "u:", "a"), (4, 0, "u", ":a"), (5, 0, "u", "x" * 9000), (6, 0, "u", "🙂é"), (7, 0, "u", "🙂é")]
    found = nodes(turns(spark, rows))
    assert {(r[0], r[1], r[3]) for r in found} == {(1, 0, 7), (1, 1, 2), (1, 2, 2), (1, 3, 2), (3, 1, 1), (4, 1, 1), (5, 1, 1), (6, 1, 2)}
    assert next(r[6] for r in found if r[0] == 6) == 2
    assert nodes(turns(spark, rows[::-1])) == found


def test_ties_and_repeated_rows(spark):
    rows = [(1, 0, "u", "a"), (1, 0, "u", "a"), (1, 0, "u", "b"), (2, 0, "u", "b"), (2, 0, "u", "a"), (2, 0, "u", "a")]
    assert {(r[0], r[1], r[3]) for r in nodes(turns(spark, rows))} == {(1, d, 2) for d in range(4)}


def test_nothing(spark):
    assert nodes(turns(spark, [])) == set()


def test_rebuilt(spark):
    from pyspark.sql import functions as F

    conversations = {0: ["a", "b", "c"], 1: ["x", "y", "z"], 2: ["p"], 105: ["q", "r", "s"], 107: ["t"]}
    own = turns(spark, rows_of(conversations))
    want = {0: ["a", "b", "c"], 1: ["a", "b", "z"], 2: ["a", "b"], 105: ["s"], 107: []}
    again = turntrie.rebuilt(own, F.lit(2), F.col("conv_id") - F.col("conv_id") % 100, most=5)
    assert {r["conv_id"]: [t["size"] for t in r["turns"]] for r in again.collect()} == {c: [1] * len(v) for c, v in want.items()}
    assert nodes(again) == by_hand(want)
