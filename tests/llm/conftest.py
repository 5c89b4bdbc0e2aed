"""Tables with the awkward cases that every operator must handle."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bits long, words string, row string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and empty texts, a null id, repeated rows, ties, a very long text, extra columns with clashing names."""
    long = " ".join(f"word{i % 997} and" for i in range(30_000))
    base = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en"), (2, None, "en"), (3, "", None), (4, " \n\t ", "de"),
        (5, long, "en"), (6, "ßü é 中 😀 \x00 x", "fr"), (7, "password=abcdefghijklmnop", "en"), (7, "password=abcdefghijklmnop", "en"),
        (None, "no id at all", "en"), (9, "one two three four", None), (10, "one two three four", "es"), (11, "12 34 !!", "en"),
    ]
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 5, "clash", "clash") for i, t, lang in base], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
