import numpy as np
from pyspark.sql import functions as F

from corposcope.llm import cascade, langid, toxicity
from corposcope.llm.common import read

SF = "/root/testdata/sf0.01"


def test_languages_of_held_out_rows(spark):
    rows = read(spark, SF, "documents").withColumn("part", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4)
    model = langid.fit(rows.where("part <> 2"))
    found = langid.predict(rows, model, extra={"part": F.col("part"), "lang": F.col("lang")}).where("part = 2")
    assert found.where("lang_pred = lang").count() >= 0.98 * found.count() > 0
    assert found.where("score between 0 and 1").count() == found.count()


def test_language_counts_are_those_of_a_loop(docs):
    rows = [(1, "Ab c"), (2, "É1b"), (3, None), (4, "12")]
    model = langid.fit(docs(rows))
    grams = np.concatenate([g for t in ("Ab c", "É1b") for g in langid.ngrams(t)])
    counts = np.bincount(grams, minlength=langid.BUCKETS) + 1.0
    assert model.languages == ("en",) and np.allclose(model.table[:, 0], np.log(counts / counts.sum()))
    # " ab c " has 6 single characters, 5 pairs and 4 triples.
    assert sum(map(len, langid.ngrams("Ab c"))) == 15


def test_pieces_do_not_change_the_ngrams(monkeypatch):
    text = "Some words, and 12 more of them; ñandú éclair."
    whole = np.sort(np.concatenate(list(langid.ngrams(text))))
    monkeypatch.setattr(langid, "CHUNK", 7)
    assert np.array_equal(np.sort(np.concatenate(list(langid.ngrams(text)))), whole)


def test_language_of_odd_rows(odd, none):
    model = langid.fit(odd)
    found = [(r["doc_id"], r["lang_pred"]) for r in langid.predict(odd, model).collect()]
    assert {i for i, lang in found if lang == "und"} == {1, 2, 3} and len(found) == odd.count()
    nothing = langid.fit(none)
    assert {r["lang_pred"] for r in langid.predict(odd, nothing).collect()} == {"und"}
    assert langid.predict(none, model).collect() == []


def test_non_negative_risk_finds_the_marked_texts():
    """A tenth of the unlabelled rows are positive; the rest never has the first feature."""
    rng = np.random.default_rng(3)
    noise = lambda n: (rng.random((n, 20)) < 0.3).astype(np.float32)
    mark = lambda n, share: (rng.random((n, 1)) < share).astype(np.float32)
    x_p = np.hstack([mark(300, 1.0), noise(300)])
    x_u = np.vstack([np.hstack([mark(100, 1.0), noise(100)]), np.hstack([mark(900, 0.0), noise(900)])])
    w, b = toxicity.train(x_p, x_u, 0.1)
    said = (x_u @ w + b) > 0
    assert said[:100].mean() >= 0.9 and said[100:].mean() <= 0.01


def test_toxic_texts_of_held_out_rows(spark):
    rows = read(spark, "/root/testdata/sf0.1", "documents")
    labels = read(spark, "/root/testdata/sf0.1", "labels", "doc_id", "toxic").withColumn("part", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5)
    model = toxicity.fit(rows, labels.where("part <> 0"))
    found = toxicity.predict(rows, model).join(labels.where("part = 0"), "doc_id")
    caught, alarms, toxic = found.select(F.sum(F.col("predicted") * F.col("toxic")), F.sum(F.col("predicted") * (1 - F.col("toxic"))), F.sum("toxic")).first()
    # Some labels of the test data are wrong on purpose.
    assert caught >= 0.6 * toxic and alarms <= 0.05 * toxic
    assert rows.where(toxicity.scored(rows, model) >= 0.5).count() == toxicity.predict(rows, model).where("predicted = 1").count()


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (5, 1), (5, 0), (6, None), (None, 1)], "doc_id BIGINT, toxic INT")
    model = toxicity.fit(odd, labels)
    rows = toxicity.predict(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    untaught = toxicity.fit(none, labels.where("false"))
    assert {r["predicted"] for r in toxicity.predict(odd, untaught).collect()} == {0}
    assert toxicity.predict(none, model).collect() == []


def repeated_by_hand(text):
    words = text.encode().split()
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)})


def test_repeated_windows():
    rng = np.random.default_rng(4)
    for _ in range(200):
        text = " ".join(rng.choice(list("ab"), rng.integers(0, 40)))
        assert cascade.Measures(text).n_repeat_words == repeated_by_hand(text)


def test_counts_of_a_text():
    m = cascade.Measures("é b\x0b#*\n \né b\x0b#*\n \n")
    assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines) == (7, 9, 4, 1)


def test_order_does_not_change_the_verdict(docs):
    rows = [(1, "fine words stand here, ten of them or even more"), (2, "few"), (3, "a " * 40), (4, "### " * 20), (5, "LOUD " + " ".join(f"WORD{chr(65 + i)}" for i in range(20)))]
    df = docs(rows)
    sample = cascade.estimate(df)
    assert {e.rule: e.rows for e in sample} == {r.name: 5 for r in cascade.RULES} and sum(e.rejected for e in sample) >= 5
    verdicts = [
        {r["doc_id"]: r["kept"] for r in cascade.judge(df, rules, estimates=[cascade.Estimate(r.name, 1 + k, 5, 5) for k, r in enumerate(rules)]).collect()}
        for rules in (cascade.RULES, cascade.RULES[::-1])
    ]
    assert verdicts[0] == verdicts[1] == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_cheap_and_rejecting_rules_come_first():
    rules = [cascade.Rule(n, lambda m: False) for n in "abc"]
    found = cascade.order(rules, [cascade.Estimate("a", 1.0, 10, 100), cascade.Estimate("b", 0.1, 9, 100), cascade.Estimate("c", 2.0, 60, 100)])
    assert [r.name for r in found] == ["b", "c", "a"]


def test_a_rejected_text_is_not_looked_at_further(docs):
    def fails(m):
        raise AssertionError("not reached")

    rules = [cascade.Rule("first", lambda m: True), cascade.Rule("second", fails)]
    ahead = [cascade.Estimate("first", 1.0, 5, 5), cascade.Estimate("second", 1.0, 0, 5)]
    assert [r["rejected_by"] for r in cascade.judge(docs([(1, "x")]), rules, estimates=ahead).collect()] == ["first"]


def test_cascade_on_odd_rows(odd, none):
    rows = cascade.judge(odd, measures=("n_words", "n_repeat_words")).collect()
    assert len(rows) == odd.count() and not any(r["kept"] for r in rows)
    assert cascade.judge(none).collect() == []
