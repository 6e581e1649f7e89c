"""Each stage of the pipeline against a plain version, on a small table of its own."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from corposcope.llm import decontam, simhash  # noqa: E402
from corposcope.llm.common import read  # noqa: E402

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = read(spark, SF, "documents")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        after = {r["doc_id"]: r for r in docs.collect()}
        assert after.keys() <= before.keys() and docs.count() == len(after)
        sizes.append(len(after))
        if name != "bpe":
            assert docs.columns == COLUMNS
        if name == "line_dedup":
            assert after.keys() == before.keys() and all(r["n_chars"] == len(r["text"]) for r in after.values())
            assert all(set(r["text"].split("\n")) <= {*before[i].split("\n"), ""} for i, r in after.items())
        elif name == "simhash_near_dedup":
            codes = {i: simhash.fingerprint(t) % (1 << 64) for i, t in before.items()}
            left = [codes[i] for i in after]
            assert not any((a ^ b).bit_count() <= 2 for i, a in enumerate(left) for b in left[:i])
            assert all(i in after or any(j != i and (c ^ codes[j]).bit_count() <= 2 for j in codes) for i, c in codes.items())
        elif name == "benchmark_decontamination":
            items = [decontam.split_item(decontam.words_of(r["text"])) for r in read(spark, SF, "benchmark").collect()]
            parts = [tuple(map(decontam.shingles, i)) for i in items]
            holds = {i for i, t in before.items() if any(min(decontam.overlap(p, decontam.words_of(t)) for p in own) >= 0.8 for own in parts)}
            assert holds and after.keys() == before.keys() - holds
    assert sizes[0] > sizes[1] and sizes[2] > sizes[3] > sizes[4] == sizes[5] > 0


def test_rows_of_one_id_and_rows_without_one(spark):
    """Whatever the order of the rows: a clean text of a doubled id stays, equal rows go once."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, "en"), (2, b, "en"), (2, a, "de"), (2, b, "de"), (None, b, "fr"), (None, c, "es"), (None, c, "en"), (None, c, "fr")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, g, None, None) for i, t, g in order], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT").repartition(3)
        got = [(r["doc_id"], r["text"], r["lang"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
        assert sorted(got, key=str) == sorted([(1, a, "en"), (2, b, "de"), (None, c, "en")], key=str)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "x" * 9000)]])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
    assert sorted(r["doc_id"] or 0 for r in docs.collect()) == ([0, 1, 3] if rows else [])
