import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, Spans string, base_spans string, text_key string, digest string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns with clashing names."""
    long = "lorem ipsum dolor sit amet " * 9000
    texts = [
        (1, "one two three four five six seven"), (2, "One  TWO three\nfour five six seven"), (3, None), (4, ""), (5, " \t\n"), (6, "short text"),
        (7, long), (8, long), (9, "A" * 30000), (10, 'token = "0123456789abcdef0123456789abcdef01234567" <|endoftext|> naïve Σίσυφος 日本語 🙂'),
        (None, "one two three four five six seven"), (None, None), (1, "one two three four five six seven"), (11, "Licensed under CC BY-NC 4.0."),
    ]
    rows = [(i, t, None if i is None else "en", None, None, None, "x", None, "y") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
