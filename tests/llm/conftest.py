import pytest

# Rows that every operator must take: null, empty and long texts, ties, repeated rows.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c"), (5, "a b c"), (None, "a b c"), (6, "x" * 50_000), (7, "word " * 20_000)]


@pytest.fixture
def docs(spark):
    """Documents with columns whose names the operators use inside."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), "extra", 1) for i, t in rows]
        return spark.createDataFrame(full, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, key STRING, fp INT")

    return make


@pytest.fixture
def odd(docs):
    return docs(ODD)


@pytest.fixture
def none(docs):
    return docs([])
