import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long, digest string, row int, bucket int, key string, size int, rank int, label string"


def rows(values):
    return [(i, t, lang, src, None if t is None else len(t), "d", 1, 2, "k", 3, 4, "l") for i, t, lang, src in values]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in each column, empty and very long texts, ties, repeated rows, and columns with names used inside."""
    long_text = "alpha beta gamma delta " * 20_000
    values = [(1, "Hello World, this is one line of text.\nAnd here is another line of it.", "en", "a"), (2, "hello world, this is one line of text.\nAnd here is another line of it.", "en", "a"), (3, None, None, None), (4, "", "de", "b"), (5, long_text, "en", "b"), (6, "   \n\t ", None, "c"), (7, "Ünïcödé ßtraße über alles 漢字 \U0001f600", "de", None), (7, "Ünïcödé ßtraße über alles 漢字 \U0001f600", "de", None), (None, "no identifier here at all", "en", "c"), (None, None, None, None), (9, "123 456 !!!", "en", "c"), (10, "Hello World, this is one line of text.\nAnd here is another line of it.", "en", "a")]
    return spark.createDataFrame(rows(values), KINDS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], KINDS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
