import random

import pytest

import corpus_pipeline
from corposcope.llm import nearcopies


def shingles_by_hand(text):
    tokens = text.lower().split()
    return {" ".join(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))}


def jaccard(a, b):
    x, y = shingles_by_hand(a), shingles_by_hand(b)
    return len(x & y) / len(x | y)


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(0, len(words), 6), n):
        words[i] = f"edit{rng.random()}"
    return " ".join(words)


@pytest.mark.parametrize("bucket", [32, 3])
def test_near_copies_go_from_the_near_duplicate_stage(spark, docs, monkeypatch, bucket):
    monkeypatch.setattr(nearcopies, "BUCKET", bucket)
    monkeypatch.setattr(nearcopies, "NEXT", 1 if bucket < 32 else nearcopies.NEXT)
    rng = random.Random(bucket)
    base = [[f"w{rng.randrange(5000)}" for _ in range(200)] for _ in range(8)]
    rows = [(10 * g, " ".join(base[g])) for g in range(8)]
    rows += [(10 * g + k, edited(rng, base[g], 4 if g % 2 else 9)) for g in range(8) for k in range(1, 8)]
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs(rows), "").collect()}
    parent = {i: i for i, _ in rows}

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i, a in rows:
        for j, b in rows:
            if i < j and jaccard(a, b) >= 0.8 and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert got == {find(i) for i in parent} and 8 < len(got) < len(rows)


def test_near_copies_on_odd_rows(odd, none):
    assert nearcopies.links(odd).collect() == [] and nearcopies.links(none).collect() == []
