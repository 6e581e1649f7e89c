import random

from corposcope.llm import decontam, license


def found(df):
    return {(r["doc_id"], r["license"]) for r in df.collect()}


def test_licenses_anywhere_in_a_text(docs):
    rng = random.Random(3)
    filler = lambda n: " ".join(rng.choice(["alpha", "beta", "license", "under", "the"]) for _ in range(n))
    rows, want = [], set()
    for i in range(60):
        name, template = license.TEMPLATES[i % len(license.TEMPLATES)]
        rows.append((i, f"{filler(rng.randint(0, 90))}\n{template.upper() if i % 2 else template} {filler(rng.randint(0, 40))}"))
        want.add((i, name))
    got = found(license.scan(docs(rows)))
    assert want <= got


def test_license_in_part(docs):
    words = license.TEMPLATES[6][1].split(" ")
    rows = [(1, " ".join(words[: len(words) * 9 // 10])), (2, " ".join(words[: len(words) // 2])), (3, "licensed under the terms that we agreed on")]
    assert found(license.scan(docs(rows))) == {(1, "gpl-3.0")}


def test_license_scan_on_odd_rows(spark, odd, none):
    assert license.scan(odd).collect() == []
    assert license.scan(none).collect() == []
    assert license.scan(odd, spark.createDataFrame([], "template_id INT, license STRING, template STRING")).collect() == []
    given = spark.createDataFrame([(1, "x", "word word word word word"), (2, "y", "too short"), (None, "z", "a b c d e f"), (3, "n", None)], "template_id INT, license STRING, template STRING")
    assert found(license.scan(odd, given)) == {(7, "x")}


def items(spark, rows):
    return spark.createDataFrame([(i, t, 0) for i, t in rows], "item_id BIGINT, text STRING, key INT")


def brute(rows, given):
    want = set()
    for i, t in given:
        if (words := decontam.words_of(t or "")):
            q, a = map(decontam.shingles, decontam.split_item(words))
            for d, x in rows:
                w = decontam.words_of(x or "")
                if min(decontam.overlap(q, w), decontam.overlap(a, w)) >= 0.8:
                    want.add((d, i))
    return want


def test_items_in_texts(spark, docs):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 60
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    given = [(i, text(rng.randint(8, 60))) for i in range(120)]
    rows = []
    for d in range(200):
        body = text(rng.randint(0, 400))
        if d % 3 == 0:
            words = given[d % 120][1].split(" ")
            if d % 2:
                words[rng.randrange(len(words))] = "changed"
            body = f"{body} {' '.join(words).title()}, {text(rng.randint(0, 200))}"
        rows.append((d, body))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.matches(docs(rows), decontam.indexes(items(spark, given))).collect()}
    assert got == brute(rows, given) and len(got) > 40


def test_shards_give_the_same(spark, docs, monkeypatch):
    rng = random.Random(5)
    given = [(i, " ".join(f"w{rng.randrange(80)}" for _ in range(20))) for i in range(40)]
    df = docs([(i, f"lead {t} tail") for i, t in given])
    whole = {tuple(r) for r in decontam.matches(df, decontam.indexes(items(spark, given))).collect()}
    monkeypatch.setattr(decontam, "SHARD_ITEMS", 9)
    parts = decontam.indexes(items(spark, given))
    assert len(parts) > 3
    split = {tuple(r) for r in decontam.matches(df, parts).collect()}
    assert {r[:2] for r in split} == {r[:2] for r in whole} and len(whole) >= 40


def test_block_max_search_is_exact(monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", 4)
    rng = random.Random(6)
    given = [[f"w{rng.randrange(60)}" for _ in range(rng.randint(3, 25))] for _ in range(50)]
    frequency: dict[str, int] = {}
    for words in given:
        for w in set(words):
            frequency[w] = frequency.get(w, 0) + 1
    index = decontam.Index([(i, w, [], w) for i, w in enumerate(given)], frequency, len(given), sum(map(len, given)) / len(given))
    for _ in range(200):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randint(1, 40))]
        terms = [index.terms[w] for w in dict.fromkeys(words) if w in index.terms]
        sums = {i: sum(dict(zip(*own, strict=True)).get(i, 0.0) for t in terms if (own := index.lists[t].get(i // index.block))) for i in range(50)}
        got = [at for block in range(index.most.shape[1]) for at, _ in index.search(terms, block)]
        assert sorted(got) == sorted(i for i, s in sums.items() if s >= 1 - 1e-9)


def test_decontamination_on_odd_rows(spark, odd, none):
    assert decontam.matches(odd, decontam.indexes(items(spark, []))).collect() == []
    index = decontam.indexes(items(spark, [(1, None), (2, ""), (None, "a b c"), (3, "a b c"), (3, "a b c")]))
    assert sorted((r["doc_id"] or 0, r["item_id"] or 0) for r in decontam.matches(odd, index).collect()) == [(0, 0), (0, 3), (5, 0), (5, 0), (5, 3), (5, 3)]
    assert decontam.matches(none, index).collect() == []
    assert decontam.without(odd, index).count() == odd.count() - 3 and decontam.without(odd, index).columns == odd.columns
    assert decontam.without(odd, decontam.indexes(items(spark, []))).count() == odd.count()


def test_items_of_few_words_and_many_shingles(spark, docs):
    """Number grids: more shingles may be missing than there are distinct words."""
    rng = random.Random(9)
    given = [(i, " ".join(rng.choice([f"{a}{i}" for a in "abcdefghij"[: 2 + i % 9]]) for _ in range(rng.randint(60, 200)))) for i in range(40)]
    rows = []
    for i, t in given:
        words = t.split(" ")
        for n in range(1, 4):
            changed = list(words)
            for at in rng.sample(range(len(words)), n):
                changed[at] = "changed"
            rows.append((10 * i + n, " ".join(changed)))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.matches(docs(rows), decontam.indexes(items(spark, given))).collect()}
    assert got == brute(rows, given) and len(got) > 40


def test_least_score_is_a_lower_bound():
    """Against every set of shingles that may be missing, on short items."""
    from itertools import combinations

    rng = random.Random(10)
    for _ in range(200):
        words = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(1, 16))]
        weights = {t: rng.random() + 0.01 for t in words}
        parts = tuple(map(decontam.shingles, decontam.split_item(words)))
        bound = decontam.least_score(weights, parts)
        assert 0 < bound <= sum(weights.values()) + 1e-9
        terms = sorted(weights)
        for n in range(len(terms) + 1):
            for gone in combinations(terms, n):
                if all(not p or sum(not set(s) & set(gone) for s in p) >= 0.8 * len(p) - 1e-9 for p in parts):
                    assert sum(w for t, w in weights.items() if t not in gone) >= bound - 1e-9


def test_text_ids_and_two_items_of_one_id(spark, docs):
    given = spark.createDataFrame([("x-1", "one two three four five six seven"), ("x-1", "red green blue cyan pink gray black"), ("y", "nothing of this is found here")], "item_id STRING, text STRING")
    rows = [(1, "say one two three four five six seven"), (2, "red green blue cyan pink gray black"), (3, "other words")]
    got = sorted((r["doc_id"], r["item_id"]) for r in decontam.matches(docs(rows), decontam.indexes(given)).collect())
    assert got == [(1, "x-1"), (2, "x-1")]


def test_separate_answers(spark, docs):
    given = spark.createDataFrame([(1, "which of the rivers is the longest one", "the one that flows north to the sea")], "item_id BIGINT, q STRING, a STRING")
    index = decontam.indexes(given, question="q", answer="a")
    rows = [(1, "Which of the rivers is the longest one? The one that flows north to the sea."), (2, "which of the rivers is the longest one"), (3, "the one that flows north to the sea")]
    assert [r["doc_id"] for r in decontam.matches(docs(rows), index).collect()] == [1]
