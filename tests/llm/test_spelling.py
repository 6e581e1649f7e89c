import random
import zlib
from collections import Counter

import pytest

from corposcope.llm import queries, spelling


def one_error(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def random_words(rng, letters, n, longest=8):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n)})


@pytest.mark.parametrize("seed", range(6))
def test_schemes_find_each_near_word_once(seed):
    """Few letters make repeats within words; patterns also have letters that no word has."""
    rng = random.Random(seed)
    words = random_words(rng, "abé🙂"[: 2 + seed % 3], 1 + 40 * seed)
    patterns = sorted({*words, *random_words(rng, "abx", 30)})
    index = spelling.Index(words)
    found = [(patterns[p], words[w]) for scheme in (spelling.HEAD, spelling.TAIL) for p, w in zip(*index.near(patterns, scheme), strict=True)]
    assert len(found) == len(set(found))
    assert set(found) == {(p, w) for p in patterns for w in words if one_error(p, w)}


def test_long_words_and_many_letters():
    words = sorted({"x" * 3000, "x" * 2999 + "y", "x" * 2999, "".join(map(chr, range(0x4E00, 0x4E00 + 400))), "".join(map(chr, range(0x4E00, 0x4E00 + 399)))})
    index = spelling.Index(words)
    found = {(words[p], words[w]) for scheme in (spelling.HEAD, spelling.TAIL) for p, w in zip(*index.near(words, scheme), strict=True)}
    assert found == {(a, b) for a in words for b in words if one_error(a, b)} and len(found) == 8


def by_hand(counts, ratio=10):
    near = {w: [x for x in counts if one_error(w, x)] for w in counts}
    form = {}
    for w, found in near.items():
        if found and counts[best := min(found, key=lambda x: (-counts[x], x))] >= ratio * counts[w]:
            form[w] = best
    rows = set()
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        rows.add((w, form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None))
    return rows


def table(spark, counts):
    return spark.createDataFrame([(w, n, "x", 1) for w, n in counts.items()], "word STRING, n BIGINT, near STRING, root INT")


@pytest.mark.parametrize("most", [16_000, 7])
def test_variants(spark, monkeypatch, most):
    """Also with blocks of a few words, where one exact half runs over several blocks."""
    monkeypatch.setattr(spelling, "BLOCK_WORDS", most)
    rng = random.Random(5)
    counts = {w: 10 ** rng.randint(0, 4) for w in random_words(rng, "abc", 150, 6)}
    counts |= {"prefixaa" + c: 5 for c in "bcdefghij"} | {"chain": 1, "chaim": 10, "chaims": 100, "chairs": 1000}
    assert {tuple(r) for r in spelling.variants(table(spark, counts)).collect()} == by_hand(counts)


def test_variants_of_nothing(spark):
    assert spelling.variants(table(spark, {})).collect() == []
    assert [tuple(r) for r in spelling.variants(table(spark, {"a": 3})).collect()] == [("a", None, "a", 3, 0, None)]
    with pytest.raises(ValueError):
        spelling.variants(table(spark, {}), ratio=1)


def test_vocabulary(spark):
    words = spark.createDataFrame([(w, 1) for w in ["b", "b", "a", "", "", None, None, "é", "é"]], "word STRING, n INT")
    assert {tuple(r) for r in spelling.vocabulary(words).collect()} == {("b", 2), ("é", 2)}


def test_words_of_documents(spark, odd, none, docs):
    texts = ["Señor ÀÉÎÕÜßx straße-WÖRTERbuch _ABCDEFGHIJ9 shorts", "x" * 5000, None, "abcdefg " * 40]
    df = docs(list(enumerate(texts)))
    want = Counter()
    for i, t in enumerate(texts):
        run = ""
        for c in (t or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "\u00c0" <= c <= "\u00ff":
                run += c.lower() if c < "\x80" else c
                continue
            if run:
                h = zlib.crc32(f"{i}:{run}".encode())
                run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
                want[run] += len(run) >= 7
            run = ""
    got = Counter(r["word"] for r in queries.spelled_words(df).collect())
    assert got == +want
    assert queries.spelled_words(none).collect() == []
    assert {len(r["word"]) for r in queries.spelled_words(odd).collect()} <= {50_000, 49_999}
