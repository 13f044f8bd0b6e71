import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents-like frame with extra columns whose names clash with internal ones."""

    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "x", "src", None if t is None else len(t), 7, "y") for i, t in zip(ids, texts)]
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, row string"
        return spark.createDataFrame(rows, schema).repartition(3, "doc_id")

    return make


ODD_TEXTS = [None, "", " \n\t ", "one", "two words", "é ü ñ 漢字 " * 40, "q" * 50_000, "same text " * 30, "same text " * 30]


@pytest.fixture(scope="session")
def odd(docs_of):
    """Null, empty, blank, short, non-ASCII, very long, and repeated texts; repeated and null keys."""
    return docs_of([*ODD_TEXTS, "key less", "key less", "twice", "twice"], [*range(9), None, None, 99, 99])
