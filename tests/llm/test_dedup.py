import random

import numpy as np
import pytest

from corposcope.llm import components, linetemplates, simhash


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_cycles(spark):
    pairs = [(i, i + 1) for i in range(12)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (7, 7), (300, None)]
    found = components.connected(spark.createDataFrame(pairs, "a BIGINT, b BIGINT"))
    want = roots([p for p in pairs if None not in p], {x for p in pairs for x in p if x is not None and x not in (7.5, 300)})
    assert {(r["node"], r["root"]) for r in found.collect()} == set(want.items())
    assert components.connected(spark.createDataFrame([], "a BIGINT, b BIGINT")).count() == 0


def fingerprint_by_hand(text, words=3):
    import xxhash

    tokens = text.encode().lower().split()
    shingles = [b" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)] or ([b" ".join(tokens)] if tokens else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", "One", "one TWO", "a b c", "a b c d e f g a b c", "É b c\x1cd e f"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == fingerprint_by_hand(text)


@pytest.mark.parametrize("bits,bucket", [(2, 32), (2, 2), (4, 2)])
def test_links_reach_all_near_fingerprints(spark, monkeypatch, bits, bucket):
    """Also with a cluster of near fingerprints, which makes large buckets."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(bits)
    codes = {rng.getrandbits(64) for _ in range(150)}
    base = rng.getrandbits(64)
    for _ in range(150):
        code = base
        for b in rng.sample(range(64), rng.randint(0, 6)):
            code ^= 1 << b
        codes.add(code)
    signed = sorted(int(np.array([c], np.uint64).view(np.int64)[0]) for c in codes)
    found = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(c,) for c in signed], "fp BIGINT"), bits).collect()}
    near = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) % (1 << 64)).bit_count() <= bits]
    assert all(((a ^ b) % (1 << 64)).bit_count() <= bits for a, b in found)
    assert roots(found, signed) == roots(near, signed)


@pytest.mark.parametrize("n", [100, 10**6, 10**10])
def test_thresholds_keep_the_pigeonhole(n):
    rng = np.random.default_rng(1)
    both = (lambda x: x.T @ x)((rng.random((500, 64)) < 0.4).astype(float)) * n / 500
    for bits in (2, 4):
        chosen = simhash.plan(n, both, bits)
        assert sorted(b for p in chosen.parts for b in p) == list(range(64))
        assert sum(chosen.limits) == bits - len(chosen.parts) + 1 and min(chosen.limits) >= -1


def test_correlated_bits_share_a_partition():
    x = np.random.default_rng(2).integers(0, 2, (4000, 64)).astype(float)
    for b in range(8):
        x[:, 40 + b] = x[:, b]
    parts = simhash.partitions(4, 4000, x.T @ x)
    # The last place of a partition may part a pair.
    assert sum(any({b, 40 + b} <= set(p) for p in parts) for b in range(8)) >= 5


def test_groups_on_odd_rows(odd, none):
    rows = [(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.groups(odd).collect()]
    assert len(rows) == odd.count()
    assert {r for r in rows if r[1] == 0} == {(1, 0, 1), (2, 0, 1), (3, 0, 1)}
    assert sorted(r[2] for r in rows if r[0] in (5, None)) == [5, 5, 5]
    assert simhash.groups(none).collect() == []


def test_a_group_without_any_key(docs):
    assert [r["component_id"] for r in simhash.groups(docs([(None, "a b c d"), (None, "a b c d")])).collect()] == [None, None]


LONG = "this line is shared by several documents of the corpus"


def kept(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_recurring_lines_stay_in_the_first_document_only(docs):
    rows = [(3, f"own first\n{LONG}\ntail"), (1, f"{LONG}\nfirst own words here"), (2, f"x\n{LONG}\n{LONG}"), (4, "nothing shared here at all, by any one")]
    assert kept(linetemplates.drop_recurring(docs(rows))) == {
        3: "own first\ntail", 1: rows[1][1], 2: "x", 4: rows[3][1],
    }


def test_variable_fields(docs):
    lines = ["request of user alice took 17 ms on host a7 today", "request of user bob took 23 ms on host b9 today", "request of user eve left 23 ms on some place tomorrow"]
    assert kept(linetemplates.drop_recurring(docs(list(enumerate(lines))))) == {0: lines[0], 1: "", 2: lines[2]}


def test_short_lines_need_more_documents(docs):
    nine = [(i, "all rights reserved") for i in range(9)]
    assert set(kept(linetemplates.drop_recurring(docs(nine))).values()) == {"all rights reserved"}
    ten = kept(linetemplates.drop_recurring(docs([*nine, (9, "all rights reserved")])))
    assert [i for i, t in ten.items() if t] == [0]


def test_line_dedup_on_odd_rows(odd, none):
    out = linetemplates.drop_recurring(odd, counts=True)
    assert out.columns[: len(odd.columns)] == odd.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["n_dropped"]) for r in out.collect()) == sorted((r["doc_id"] or 0, r["text"] or "", 0) for r in odd.collect())
    assert linetemplates.drop_recurring(none).collect() == []
    assert [r["text"] for r in linetemplates.drop_recurring(odd.where("doc_id = 1")).collect()] == [None]


def test_passages_go_whole(docs):
    """Two documents share a passage with short lines; short lines alone stay."""
    passage = f"Chapter one\n\nby the sea\n{LONG}\nThe end"
    rows = [(1, f"mine\n{passage}"), (2, f"{passage}\n\nyours"), (3, "by the sea\nown words\nThe end")]
    got = kept(linetemplates.drop_recurring(docs(rows), passages=True))
    assert got == {1: rows[0][1], 2: "\n\nyours", 3: rows[2][1]}


def test_very_short_and_unsegmented_lines(docs):
    rows = [(i, f"own{i}\nLes.") for i in range(10)] + [(20, "新しい線路は山を越えて海まで続いています。"), (21, "新しい線路は山を越えて海まで続いています。"), (22, "短い線")]
    got = kept(linetemplates.drop_recurring(docs(rows), passages=True))
    assert [got[i] for i in range(10)] == ["own0\nLes.", *(f"own{i}" for i in range(1, 10))]
    assert got[20] == rows[10][1] and got[21] == "" and got[22] == "短い線"
